"""Quotation linking against its SQL and brute force on generated threads; odd rows."""

import random
import re

import duckdb

from skein.llm import queries, quotes
from tests.test_oracle import as_rows

NAMES = "conv_id long, turn long, role string, text string"
PEOPLE = ("On Monday A wrote:", "Am Montag schrieb B:")


def generated(seed):
    """``(rows, parents)`` of threads whose messages quote earlier ones whole, by line, by sentence, wrapped anew, or at two levels."""
    rng, rows, answers = random.Random(seed), [], {}
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))

    def sentence():
        return " ".join(word() for _ in range(rng.randint(1, 9))).capitalize() + rng.choice(".!?")

    for conv in range(25):
        own = []
        for turn in range(rng.randint(2, 9)):
            said = [[sentence() for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 3))]
            text = "\n\n".join(" ".join(p) for p in said)
            body, parent = [], None
            if own and rng.random() < 0.7:
                parent = rng.randrange(len(own))
                paragraph = rng.choice(own[parent])
                how = rng.randrange(4)
                quoted = " ".join(paragraph) if how < 2 else rng.choice(paragraph)
                if how == 1:  # wrapped anew
                    ws = quoted.split(" ")
                    cut = rng.randint(1, len(ws))
                    quoted = [" ".join(ws[i : i + cut]) for i in range(0, len(ws), cut)]
                else:
                    quoted = [quoted]
                if rng.random() < 0.5:
                    body.append(rng.choice(PEOPLE))
                body += [f"> {q.upper() if how == 3 else q}" for q in quoted]
                if parent and answers.get((conv, parent)) is not None and rng.random() < 0.5:
                    body.append(f">> {rng.choice(own[answers[conv, parent]])[0]}")
            if rng.random() < 0.2:
                text = f"{PEOPLE[0]}\n{text}"  # no quote follows: text
                said[0][0] = f"{PEOPLE[0]} {said[0][0]}"
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), "\n".join([*body, text])))
            answers[conv, turn] = parent
            own.append(said)
    return rows, answers


def in_duckdb(rows):
    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    cursor = c.execute(queries.SQL["op4_quote_threads"])
    return [x[0] for x in cursor.description], cursor.fetchall()


def brute(rows):
    """Parents by lists and loops."""
    fold = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", x.lower()).strip(" ")
    found, first = {}, {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            first[r[:2]] = min(first.get(r[:2], r), r, key=lambda r: (r[2] is not None, r[2] or "", quote_key(r[3])))

    def parts(text):
        parsed = [(len(re.findall(">", (re.match(quotes.MARKS, x) or [""])[0])), re.sub(quotes.MARKS, "", x)) for x in re.split("\r?\n", text or "")]
        blank = lambda x: not x[1].strip()
        kept = []
        for i, x in enumerate(parsed):
            below = parsed[i + 1 : i + 3]
            quote = below and (below[0][0] > 0 or (below[0][0] == 0 and blank(below[0]) and len(below) > 1 and below[1][0] > 0))
            if not (x[0] == 0 and re.search(quotes.ATTRIBUTION, x[1]) and quote):
                kept.append(x)
        runs, last = [], None
        for x in kept:
            kind = None if blank(x) else x[0]
            if kind is not None and kind == last:
                runs[-1] = (kind, runs[-1][1] + " " + x[1])
            elif kind is not None:
                runs.append(x)
            last = kind
        every = [*kept, *runs, *((n, t) for n, x in runs for t in re.findall(quotes.SENTENCE, x))]
        return {(n, fold(x)) for n, x in every} - {(n, "") for n, _ in every}

    units = {k: parts(r[3]) for k, r in first.items()}
    for (conv, turn), own in units.items():
        votes = {}
        for level, unit in own:
            origins = [t for (c, t), us in units.items() if c == conv and t < turn and (0, unit) in us]
            if level and origins:
                # the earliest turn of all that has the unit, if it came before
                t = min(t for (c, t), us in units.items() if c == conv and (0, unit) in us)
                votes[level, t] = votes.get((level, t), 0) + len(unit)
        if votes:
            found[conv, turn] = max((-level, n, t) for (level, t), n in votes.items())[2]
    return found


def quote_key(text):
    import hashlib

    return hashlib.md5((text or "").encode()).hexdigest()


ODD = [
    (500, 0, "user", "Agreed."), (500, 1, "user", "> Agreed.\nWhy?"), (500, 2, None, "> agreed.  \n>\n> Why?\n"), (500, 2, "user", "> Why?\nlater row of the turn"), (500, 2, "user", "> Why?\nlater row of the turn"),
    (501, 0, "user", None), (501, 1, "user", ""), (501, 2, "user", ">"), (501, 3, "user", "> > >> deep\n"), (501, None, "user", "> Agreed."), (None, 3, "user", "> Agreed."),
    (502, 0, "user", "On Monday the committee wrote:\nThe plan is off."), (502, 1, "user", "On Monday the committee wrote:\n\n> The plan is off.\nIs it?"), (502, 2, "user", "> On Monday the committee wrote:\n> The plan is off.\nYes."),
    (503, 0, "user", "x " * 100_000 + "end."), (503, 1, "user", "> " + "x " * 100_000 + "\n> end.\nlong"),
]


def test_generated_threads_match_sql_and_brute_force(spark):
    for seed in (1, 2):
        rows, answers = generated(seed)
        rows += ODD
        out = quotes.conversations(spark.createDataFrame(rows, NAMES))
        got = out.collect()
        columns, want = in_duckdb(rows)
        assert as_rows(out.columns, got) == as_rows(columns, want)
        found = {(r.conv_id, r.turn): r.parent for r in got if r.parent is not None}
        assert found == brute(rows)
        linked = {k: p for k, p in answers.items() if p is not None}
        assert sum(found.get(k) == p for k, p in linked.items()) >= 0.95 * len(linked)
        assert [(r.conv_id, r.root, r.depth, r.turn) for r in got] == sorted(((r.conv_id, r.root, r.depth, r.turn) for r in got), key=lambda k: [(x is not None, x or 0) for x in k])


def test_odd_threads(spark):
    names = NAMES + ", lines int, level int, mark int, root int, h int"
    rows = quotes.conversations(spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in ODD], names)).collect()
    by = {(r.conv_id, r.turn, r.role, r.content[:20]): (r.parent, r.root, r.depth) for r in rows}
    assert len(rows) == len(ODD)
    assert by[500, 1, "user", "Why?"] == (0, 0, 1)
    # the first row of the turn, without a role, quotes the first two turns; more characters are the first's
    assert by[500, 2, None, ""] == by[500, 2, "user", "later row of the tur"] == (0, 0, 1)
    assert [by[501, i, "user", ""] for i in range(4)] == [(None, i, 0) for i in range(4)]
    assert by[None, 3, "user", ""] == (None, 3, 0) and by[501, None, "user", ""] == (None, None, 0)
    assert by[502, 0, "user", "On Monday the commit"] == (None, 0, 0)
    assert by[502, 1, "user", "Is it?"] == (0, 0, 1) and by[502, 2, "user", "Yes."][0] == 0
    assert by[503, 1, "user", "long"] == (0, 0, 1)
