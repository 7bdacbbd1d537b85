"""Groups of spelling variants: words one edit apart meet in sorted rotations of their terminator-marked forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Not a letter of any word.
TERMINATOR = "$"
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"


def counted_words(df: DataFrame, id_col: str, text_col: str, shortest: int, least: int, every: int | None) -> DataFrame:
    """``(word, n)``: runs of letters of ``shortest`` code points or more that occur ``least`` times or more, A-Z lower-cased.

    With ``every``, a run of which the CRC-32 of ``id:run`` is divisible by it
    loses the code point at that value modulo its length first. Counts are
    combined before they are shuffled, so no word makes a large task.
    """
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({LETTERS}{{{shortest},}})"), F.lit(1))).alias("run"))
    word = F.translate("run", UPPER, LOWER)
    runs = runs.select("id", word.alias("word"))
    if every is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(F.col("h"), F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _rotations(words: DataFrame) -> DataFrame:
    """``(prefix, last, n)``: rotations of ``word$``, each as itself (``last`` empty) and as what precedes its last letter.

    A word ``x c y`` has the rotation ``y$xc``. All words of which only ``c``
    is another have the prefix ``y$x`` and one letter after it, and the word
    without ``c`` has the rotation ``y$x`` itself.
    """
    at = words.select("word", "n", F.explode(F.expr("sequence(0, length(word))")).alias("i"))
    head = F.substring("word", F.lit(1), F.col("i"))
    tail = lambda skip: F.substring("word", F.col("i") + 1 + skip, F.length("word"))
    own = F.struct(F.concat(tail(0), F.lit(TERMINATOR), head).alias("prefix"), F.lit("").alias("last"))
    cut = F.when(F.col("i") < F.length("word"), F.struct(F.concat(tail(1), F.lit(TERMINATOR), head).alias("prefix"), F.substring("word", F.col("i") + 1, F.lit(1)).alias("last")))
    both = at.select("n", F.explode(F.array_compact(F.array(own, cut))).alias("r"))
    return both.select("r.prefix", "r.last", "n")


def _neighbours(prefix: str, letters: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """``(word, n_near, near_n, near)`` of the words of one prefix that have near ones in it; ``near`` is the most frequent.

    A letter that repeats the one before it may be dropped for that one, so
    the pair of such a word and the shorter one is told where the run begins.
    """
    y, _, x = prefix.partition(TERMINATOR)
    spelt = sorted((-n, x + c + y, not prefix.endswith(c)) for c, n in zip(letters, counts, strict=True) if c)
    short = [(-n, x + y) for c, n in zip(letters, counts, strict=True) if not c]
    openers = [s for s in spelt if s[2]]
    for k, s in enumerate(spelt):
        others = [spelt[k == 0][:2]] if len(spelt) > 1 else []
        others += short if s[2] else []
        if others:
            n, word = min(others)
            yield s[1], len(spelt) - 1 + (len(short) if s[2] else 0), -n, word
    if short and openers:
        yield short[0][1], len(openers), -openers[0][0], openers[0][1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within each prefix of rows sorted by prefix; a prefix has no more rows than the alphabet and one."""
    rest: pa.Table | None = None

    def told(rows: pa.Table) -> pa.RecordBatch:
        prefix = rows.column("prefix").combine_chunks()
        same = pc.equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False)
        shared = np.zeros(len(prefix), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        few = rows.filter(pa.array(shared))
        keys, letters, counts = (few.column(c).to_pylist() for c in ("prefix", "last", "n"))
        out: list[tuple[str, int, int, str]] = []
        start = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[start]:
                out.extend(_neighbours(keys[start], letters[start:end], counts[start:end]))
                start = end
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "near_n", "near"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        prefix = rows.column("prefix")
        done = rows.num_rows - 1
        while done > 0 and prefix[done - 1] == prefix[rows.num_rows - 1]:
            done -= 1
        rest = rows.slice(done)
        if done:
            yield told(rows.slice(0, done))
    if rest is not None:
        yield told(rest)


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: the end of each chain, whose known parts double in every round."""
    roots = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = scratch.keep(roots.join(further, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        scratch.drop(roots)
        roots = moved.select("word", "root")
        roots._kept_at = moved._kept_at
        if moved.where("moved").isEmpty():
            return roots


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, near_n, near)`` of ``words(word, n)`` with a word one edit apart; ``near`` has the largest ``n``, then the least code points."""
    dealt = _rotations(words).repartition(F.col("prefix")).sortWithinPartitions("prefix", "last")
    told = dealt.mapInArrow(_scan, "word string, n_near long, near_n long, near string")
    best = told.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    return best.select("word", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.w").alias("near"))


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, times: int = 10, every: int | None = None,
) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of the words of all texts, one row a word.

    Words are maximal runs of ``A-Z a-z`` and U+00C0 to U+00FF, A-Z
    lower-cased, of ``shortest`` code points and ``least`` occurrences or more.
    ``n_near`` counts the words one inserted, deleted or replaced code point
    away; ``form`` is the most frequent of them (of equals the least in
    code-point order) if it occurs ``times`` times as often as the word, and
    ``root`` what the forms lead to, the word itself without one. ``every``
    plants misspellings, see ``counted_words``.

    A word of L letters gives 2 L + 1 rotations. Those that share a prefix are
    one word, at most, and one more for each letter, so a scan of the sorted
    rotations holds few rows, and each pair meets in one prefix alone. Null
    texts have no words, null ids count as empty ones, repeated rows count
    each time; an empty table gives an empty result; extra columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "spelling")
    words = scratch.keep(counted_words(df, id_col, text_col, shortest, least, every))
    near = near_words(words)
    formed = F.col("near_n") >= times * F.col("n")
    forms = scratch.keep(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    roots = _roots(scratch, forms.where(F.col("form").isNotNull()))
    return forms.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
