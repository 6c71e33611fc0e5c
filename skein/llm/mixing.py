"""Mixing sources to target weights with DataFrame functions alone.

Source token shares p are raised to an exponent a in [0, 1] and normalised. The
exponent is bisected until the mixture meets a target: an entropy, or a limit on
how often any source is repeated. Budgets are weight times budget tokens. Each
source's documents stand in a permutation of blocks (about the square root of its
documents, dealt by hash) and of documents in each block; a source contributes whole
passes and, of one more pass, the documents that fit into what its budget has
left. Running sums are taken in a block and over blocks, so no group outgrows
the square root of a source.

Defined results: a null source counts as the source with the empty name; a null or
blank text has no tokens and costs no budget; a source without tokens gets weight 0 and
no copies, or one with ``cover``; repeated rows are drawn one by one; null ids come back;
an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.plans.scratch import fresh_name, materialise

LEVELS, ROUNDS = 4, 8
WORDS = r"[^\x20\x09-\x0D]+"


def _key(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, tokens)``, tokens being words of the whole text."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), tokens.alias("tokens"))


def source_stats(counted: DataFrame) -> DataFrame:
    """``(source, n_docs, source_tokens)``; sums are partial before the shuffle."""
    return counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("source_tokens"))


def solve_exponent(stats: DataFrame, total: int, target_entropy: float | None = None, max_repeat: float | None = None, cover: bool = False) -> float:
    """The exponent that meets the target, by bisection.

    A job evaluates all midpoints of the next ``LEVELS`` levels as sums over the
    sources; one row of them goes to the driver. Entropy (a share of the log of the
    number of sources) falls as the exponent grows: the largest exponent that still
    reaches ``target_entropy`` is taken. Repetition falls too: the least exponent is
    taken whose most repeated source stays within ``max_repeat`` passes.
    """
    if target_entropy is None and max_repeat is None:
        return 1.0
    p = F.col("source_tokens") / F.lit(float(total))
    held = stats.where("source_tokens > 0")
    low, high, n = 0.0, 1.0, 1 << LEVELS
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / n for i in range(n + 1)]
        sums = []
        for a in points:
            w = F.pow(p, F.lit(a))
            sums += [F.sum(w), F.sum(w * F.log(p)) * F.lit(a), F.max(F.pow(p, F.lit(a - 1))), F.min(F.pow(p, F.lit(a - 1)))]
        row = held.agg(F.count("*"), *sums).first()
        if not row[0]:
            return 1.0
        ok = []
        for i in range(n + 1):
            z, s, most, least = row[1 + 4 * i : 5 + 4 * i]
            if target_entropy is not None:
                ok.append(_log(z) - s / z >= target_entropy * _log(row[0]))
            else:
                ok.append((most / least if cover else most / z) <= max_repeat)
        if target_entropy is not None:
            if not ok[0]:
                return 0.0
            i = max(j for j in range(n + 1) if ok[j])
            if i == n:
                return high
            low, high = points[i], points[i + 1]
        else:
            if not ok[n]:
                return 1.0
            i = min(j for j in range(n + 1) if ok[j])
            if i == 0:
                return low
            low, high = points[i - 1], points[i]
    return low if target_entropy is not None else high


def _log(x: float) -> float:
    from math import log

    return log(x)


def mix(docs: DataFrame, budget_tokens: int | None = None, target_entropy: float | None = None, max_repeat: float | None = 2.0, cover: bool = False, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, block, tokens, weight, copies)`` for every row of ``docs``.

    ``budget_tokens`` defaults to the corpus's own; ``cover`` takes instead the
    least budget that draws every document at least once, those of sources without
    tokens once.
    """
    counted = materialise(count_tokens(docs, id_col, text_col, source_col), "counted")
    stats = materialise(source_stats(counted), "sources")
    total = stats.agg(F.sum("source_tokens")).first()[0] or 0
    alpha = solve_exponent(stats, total, target_entropy, max_repeat, cover)
    p = F.col("source_tokens") / F.lit(float(total or 1))
    weighed = stats.withColumn("w", F.when(F.col("source_tokens") > 0, F.pow(p, F.lit(alpha))).otherwise(0.0))
    z, scale = weighed.agg(F.sum("w"), F.max(F.try_divide(p, F.col("w")))).first()
    z, scale = z or 1.0, scale or 1.0
    budget = float(budget_tokens if budget_tokens is not None else total)
    if cover:
        budget = total * scale * z
    weighed = weighed.withColumn("weight", F.col("w") / F.lit(z)).withColumn("budget", F.col("weight") * F.lit(budget))
    passes = F.coalesce(F.floor(F.try_divide(F.col("budget"), F.col("source_tokens")) + F.lit(1e-9)), F.lit(int(cover))).cast("long")
    plan = materialise(
        weighed.select(
            F.col("source").alias("of"), "weight", passes.alias("passes"), F.greatest(F.lit(0.0), F.col("budget") - passes * F.col("source_tokens")).alias("rest"),
            F.ceil(F.sqrt(F.col("n_docs").cast("double"))).cast("long").alias("n_blocks"), "source_tokens",
        ),
        "plan",
    )
    placed = counted.join(plan, F.col("source") == F.col("of"))
    at = F.pmod(_key(str(seed), "block", F.col("source"), F.col("doc_id").cast("string")), F.col("n_blocks"))
    placed = placed.withColumn("block", at).withColumn("place", _key(str(seed), "place", F.col("source"), F.col("doc_id").cast("string")))
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id", "tokens")
    placed = placed.withColumn("upto", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = placed.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("bs"), F.col("block").alias("bb"), F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("before"))
    joined = placed.join(blocks, (F.col("source") == F.col("bs")) & (F.col("block") == F.col("bb")))
    extra = F.when((F.col("source_tokens") > 0) & (F.col("before") + F.col("upto") <= F.col("rest")), F.lit(1)).otherwise(0)
    return joined.select("doc_id", "source", "block", "tokens", "weight", (F.col("passes") + extra).cast("long").alias("copies"))


def draws(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """One row per drawn copy: ``(doc_id, source, pass, block_place, place)``.

    A source's copies stand in order of pass, block_place and place: each pass is a
    permutation of its blocks, another one each time, and of the documents in each block.
    """
    rows = mixed.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    at = F.col("pass").cast("string")
    return rows.select(
        "doc_id", "source", "pass",
        _key(str(seed), "blocks", at, F.col("source"), F.col("block").cast("string")).alias("block_place"),
        _key(str(seed), "draw", at, F.col("source"), F.col("doc_id").cast("string")).alias("place"),
    )


def keep_mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, with their own columns.

    Rows with equal ids take the copies of the one drawn most; a row without an id is drawn once.
    """
    of, n, copy = (fresh_name(docs, x) for x in ("of", "n", "copy"))
    copies = mix(docs, id_col=id_col, **options).groupBy(F.col("doc_id").alias(of)).agg(F.max("copies").alias(n))
    joined = docs.join(copies, docs[id_col] == F.col(of), "left")
    times = F.when(F.col(of).isNull(), F.lit(1)).otherwise(F.col(n)).cast("int")
    return joined.where(times > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*[docs[c] for c in docs.columns])
