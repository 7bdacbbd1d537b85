"""Document quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = "[\\x20\\x09-\\x0D]+"
GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of four languages; the rule asks for a share of all words that texts of any length reach.
STOP_WORDS = (
    "the of and to in a is that for it with as was on are by this be at or from "
    "le la les de des et en un une du que qui dans pour pas au il elle est "
    "der die das und ist von zu mit den dem ein eine nicht auf im für sich "
    "el los las y del por con una para es su se no al"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures and the range it must lie in; ``from_words`` is the least length it judges."""

    name: str
    top: str
    bottom: str
    least: float | None
    most: float | None
    from_words: int = 1


#: The thresholds; a document is kept if it passes the base rules and every row here.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.3),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.002, None, 30),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def _repeat_words(text_words: Column) -> Column:
    """Words that lie in a window of five words found at least twice in the text.

    Windows are sorted by hash, the places of equal neighbours are sorted
    again, and each place adds its window's words up to the next place.
    Texts whose windows all differ stop at the hash set.
    """
    hashes = lambda of: F.transform(F.sequence(F.lit(1), F.size(of) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(of, i, WINDOW)))

    def places(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            hit = F.filter(F.transform(s, lambda x, i: F.when(
                ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
            return let(F.sort_array(hit), lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(paired, repeated))

    # the words are bound, too: the optimizer may put their expression in place of their column
    return let(text_words, lambda of: F.when(F.size(of) < WINDOW, F.lit(0)).otherwise(let(hashes(of), places))).cast("long")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the measures; nothing to divide by passes."""
    verdict = F.lit(True)
    for r in rules:
        # no division, so no rounding: least * bottom <= top <= most * bottom
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (F.col(r.top) >= F.lit(r.least) * F.col(r.bottom))
        if r.most is not None:
            ok = ok & (F.col(r.top) <= F.lit(r.most) * F.col(r.bottom))
        verdict = verdict & (ok | (F.col("n_words") < r.from_words))
    return verdict


def rule_sql(r: Rule) -> str:
    """A row of the table as SQL over columns of the measures' names."""
    sides = [f"{r.top} {sign} CAST({limit!r} AS DOUBLE) * {r.bottom}" for sign, limit in ((">=", r.least), ("<=", r.most)) if limit is not None]
    return f"({' AND '.join(sides)} OR n_words < {r.from_words})"


def measures(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and the measures, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail; a text is judged alone, so
    repeated rows give equal rows and an empty table an empty result. Columns
    of ``df`` named like a measure are not supported in ``keep``: callers
    rename them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cols = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.translate(x, GAPS, "")) > 0)
    out = df.select(*cols, text.alias("_t"))
    out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != "_t"], "_t", words(F.col("_t")).alias("_w"), lines.alias("_l"))
    length = lambda x: F.char_length(x).cast("long")
    out = out.select(
        *[F.col(f"`{c}`") for c in out.columns if c not in ("_t", "_w", "_l")],
        F.size("_w").cast("long").alias("n_words"),
        length(F.translate("_t", GAPS, "")).alias("word_chars"),
        (length(F.col("_t")) - length(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size(F.filter(F.split(F.lower("_t"), "[^\\p{L}]+"), lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & compiled())


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, measures.., base_failed, kept)`` of every row; extra columns are ignored."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return measures(slim, "text", ["id"])


def kept_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text passes, with their own columns only."""
    wrapped = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"))
    return measures(wrapped, "text", ["row"]).where("kept").select("row.*")
