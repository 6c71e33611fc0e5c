"""Quality rules with host-level verdicts.

Each text is measured once. Rule failures are summed by host (partial sums
before the shuffle, so a host with a third of all rows is one small row per
task), the rates are shrunk towards the corpus with a beta prior fitted by
moments to the hosts, and the hosts' verdicts go back to their documents.

Defined results: a null text counts as empty and fails; a null host counts as the
host with the empty name; repeated rows are judged one by one; null ids come back; an
empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skein.plans.scratch import materialise

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Soft rules over the measures, by name: SQL text, true where a document fails.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
    "repeats": "5 * n_repeat_words > n_words",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: dict = {}
            for i, x in enumerate(windows):
                seen.setdefault(x, []).append(i)
            hit = bytearray(n)
            for at in seen.values():
                if len(at) > 1:
                    for i in at:
                        hit[i] = hit[i + 1] = hit[i + 2] = 1
            repeated = sum(hit)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(doc_id, host, *MEASURES)`` of every whole text, batch by batch."""
    return _measured(docs.select(F.col(id_col).alias("doc_id"), _host(host_col), F.col(text_col).alias("text")))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")


def _measured(rows: DataFrame, inside: int | None = None) -> DataFrame:
    """Measures of ``(doc_id, host, text)``; with ``inside`` the text is that field of the struct ``doc_id``, so that it goes to Python once."""
    out = StructType([rows.schema["doc_id"], StructField("host", StringType()), *(StructField(m, LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(x.as_py()) for x in (b.column("text") if inside is None else b.column("doc_id").field(inside))]
            columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *columns], ["doc_id", "host", *MEASURES])
        pa.default_memory_pool().release_unused()  # workers live on beside those of later stages

    return rows.mapInArrow(run, out)


def with_failures(measured: DataFrame) -> DataFrame:
    """Add ``base_failed`` and one ``fail_<rule>`` flag for each soft rule."""
    return measured.select(
        "*",
        F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words").alias("base_failed"),
        *[F.expr(f"n_words > 0 and ({sql})").alias(f"fail_{name}") for name, sql in RULES.items()],
    )


def host_verdicts(judged: DataFrame, strict_above: float = 0.5) -> DataFrame:
    """One row per host: documents, shrunk failure rates and a verdict per rule.

    For each rule the hosts' rates have mean m and variance v; a beta prior with
    these moments (a + b held within 1 to 10,000) is added to the host's counts.
    ``strict_<rule>`` is true where the posterior mean exceeds ``strict_above``.
    Only one row of moments goes to the driver.
    """
    sums = judged.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"n_{r}") for r in RULES])
    rates = [F.col(f"n_{r}") / F.col("n_docs") for r in RULES]
    moments = sums.agg(*[f(x) for x in rates for f in (F.avg, F.var_pop)]).first()
    out = sums
    for i, r in enumerate(RULES):
        a, b = _beta(moments[2 * i], moments[2 * i + 1])
        rate = (F.col(f"n_{r}") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"strict_{r}", rate > strict_above)
    return out


def _beta(mean: float | None, var: float | None) -> tuple[float, float]:
    """Beta parameters with the given moments; a flat spread gives the strongest prior allowed."""
    m = min(max(mean or 0.0, 1e-6), 1 - 1e-6)
    total = m * (1 - m) / var - 1 if var else 1e4
    total = min(max(total, 1.0), 1e4)
    return m * total, (1 - m) * total


def stored_verdicts(judged: DataFrame, strict_above: float = 0.5) -> DataFrame:
    """``(verdict_host, strict_<rule>...)``, stored, so that its size is known: a small table is broadcast and no document moves."""
    strict = host_verdicts(judged, strict_above).select(F.col("host").alias("verdict_host"), *[f"strict_{r}" for r in RULES])
    return materialise(strict, "verdicts")


def decide(judged: DataFrame, strict: DataFrame, needed: int = 2) -> DataFrame:
    """The judged rows with ``kept`` and ``n_failed`` under their hosts' verdicts."""
    joined = judged.join(strict, F.col("host") == F.col("verdict_host"), "left")
    failures = sum((F.col(f"fail_{r}").cast("int") for r in RULES), F.lit(0))
    condemned = F.lit(False)
    for r in RULES:
        condemned = condemned | (F.col(f"fail_{r}") & F.coalesce(F.col(f"strict_{r}"), F.lit(False)))
    kept = ~F.col("base_failed") & ~condemned & (failures < needed)
    return joined.select("doc_id", "host", *MEASURES, "base_failed", kept.alias("kept"), failures.alias("n_failed"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", strict_above: float = 0.5, needed: int = 2) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for every row of ``docs``.

    A document that passes the base rules goes only if it fails ``needed`` soft
    rules, or a single one that its host is strict about: a bad host tightens
    the rules for its documents, and never condemns a clean one.
    """
    judged = with_failures(materialise(measures(docs, id_col, text_col, host_col), "measures"))
    return decide(judged, stored_verdicts(judged, strict_above), needed)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", strict_above: float = 0.5, needed: int = 2) -> DataFrame:
    """The rows of ``docs`` that no verdict rejects, with their own columns.

    Texts are measured twice, for the hosts' sums and again where each row is kept or goes:
    a row is judged by its own text whatever its id, and no text moves.
    """
    judged = with_failures(materialise(measures(docs, id_col, text_col, host_col), "measures"))
    rows = docs.select(F.struct("*").alias("doc_id"), _host(host_col))
    text = [c.lower() for c in docs.columns].index(text_col.lower())
    return decide(with_failures(_measured(rows, text)), stored_verdicts(judged, strict_above), needed).where("kept").select("doc_id.*")
