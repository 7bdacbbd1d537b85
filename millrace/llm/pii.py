"""Personal data: pattern spans, and terms near them that disclose whom they belong to.

Everything here is a DataFrame expression; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let
from .shared import Scratch

#: A code point of the private use area that marks matches; texts that hold it are read with MARK_AS in its place.
MARK, MARK_AS = "\ue000", "\ue001"

#: Kinds with their patterns. Runs are possessive and begin at a run's first
#: character (or where the last match ended), so no text takes quadratic time;
#: what they match equals the plain patterns' matches.
KINDS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
DIGITS_ONLY = "[^0-9]"
#: A term is generalised if it tells at least this share of what its entity's name tells.
DISCLOSES = 0.9
#: Added to each count of documents.
SMOOTH = 0.5
#: What stands in a sanitised text for a disclosing term; a match's kind stands for it likewise.
TERM = "[TERM]"


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, DIGITS_ONLY, "")
    if kind == "ip":
        return found.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.char_length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


#: Numbers that are gathered one after the other; what blocks of them give is gathered likewise.
BLOCK = 256
#: Code points of the pieces that a text is cut into to be read from the middle.
PIECE = 4096


def _so_far(numbers: Column, gather: Callable[[Column, Column], Column]) -> Column:
    """array<int>: for each of the numbers, none negative, what ``gather`` makes of those before it; 0 without any.

    A fold that appends copies what it has, so it goes over blocks of numbers
    and then over what the blocks give, which keeps long arrays cheap.
    """

    def fold(xs: Column) -> Column:
        blank = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, blank, lambda a, n: F.struct(gather(a["at"], n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / BLOCK).cast("int")), lambda b: F.slice(numbers, b * BLOCK + 1, BLOCK))
    return let(F.transform(blocks, fold), lambda scanned: F.flatten(F.zip_with(
        scanned, fold(F.transform(scanned, lambda s: s["at"]))["out"], lambda s, at: F.transform(s["out"], lambda x: gather(x, at)))))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text cut into ``pieces``, without a walk from its beginning."""
    first = F.floor(start / PIECE).cast("int")
    few = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(few, ""), start % PIECE + 1, end - start)


def _places(p: Column) -> Column:
    """array<struct<start, i>> of every second part, with its place in code points."""
    before = let(F.transform(p, lambda x: F.char_length(x)), lambda lengths: _so_far(lengths, lambda a, b: a + b))
    return F.filter(F.transform(before, lambda at, i: F.struct(at.alias("start"), i.alias("i"))), lambda s: s["i"] % 2 == 1)


def spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of the kind's valid matches, by start.

    Matches are wrapped in marks and the text is split at them: every second
    part is a match, and the lengths so far give its place in code points.
    """
    pattern = KINDS[kind]
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def places(p: Column) -> Column:
        found = F.transform(_places(p), lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.char_length(F.get(p, s["i"]))).alias("end"), F.get(p, s["i"]).alias("value")))
        return F.filter(found, lambda s: valid(kind, s["value"]))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(parts, places)).otherwise(none)


def _unmatched(text: Column) -> Column:
    """The text with spaces for what an address holds; the other kinds hold no letters."""
    parts = F.split(F.regexp_replace(text, KINDS["email"], f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(text.rlike(KINDS["email"]), F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.char_length(x))).otherwise(x)), "")).otherwise(text)


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, "[^\\p{L}]+")), lambda w: w != "")


def _word_places(text: Column) -> Column:
    """array<struct<start, end, form>> of every word of a text."""
    parts = F.split(F.regexp_replace(text, "\\p{L}++", f"{MARK}$0{MARK}"), MARK, -1)
    return let(parts, lambda p: F.transform(_places(p), lambda s: F.struct(
        s["start"].alias("start"), (s["start"] + F.char_length(F.get(p, s["i"]))).alias("end"), F.get(p, s["i"]).alias("form"))))


def _hashed(words: Column) -> Column:
    """The words' lower-cased forms as hashes, each once."""
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(F.lower(w))))


def _entity(s: Column) -> Column:
    """Hash of a matched value's kind and normal form."""
    form = F.when(s["kind"].isin("card", "phone"), F.regexp_replace(s["value"], DIGITS_ONLY, "")).otherwise(F.lower(s["value"]))
    return F.xxhash64(s["kind"], form)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", discloses: float = DISCLOSES) -> DataFrame:
    """``(id, base array, terms array, text)`` of every row: pattern spans and disclosing terms; ``text`` is null where there is no span.

    For a term t and an entity e (a matched value in normal form), n documents,
    df(x) the documents that hold x and df(t, e) those that hold both,
    disclosure is log(n df(t, e) / (df(t) df(e))) / log(n / df(e)): the share of
    e's information content that t gives away. All counts cover all documents,
    each told apart by id and text and counted once, and whole texts, outside
    of matched addresses, and have ``SMOOTH`` added (n twice that), so an entity
    of a single document counts like any other. Every place of a disclosing
    term in a text with its entity is given.
    Nulls are empty texts; rows equal in id and text get the same spans; an
    empty table gives an empty result; extra columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "pii")
    raw = F.col(f"`{text_col}`").cast("string")
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.translate(F.coalesce(raw, F.lit("")), MARK, MARK_AS).alias("text"), raw.alias("raw"))
    # documents are told apart by two hashes, so that a null id is a value like others
    slim = slim.select("id", F.xxhash64("id").alias("i"), F.xxhash64("text").alias("h"), "text", "raw")
    base = F.concat(*[spans(F.col("text"), k) for k in KINDS])
    # texts are kept with their spans, and only where there are any
    found = scratch.keep(slim.select("id", "i", "h", base.alias("base"), "raw").withColumn("raw", F.when(F.size("base") > 0, F.col("raw"))))
    rest = _unmatched(F.translate(F.coalesce("raw", F.lit("")), MARK, MARK_AS))
    owners = found.where(F.size("base") > 0).select("i", "h", F.array_distinct(F.transform("base", _entity)).alias("entities"), rest.alias("rest")).dropDuplicates(["i", "h"])
    owners = scratch.keep(owners)
    # entities of the same documents disclose alike: a set of documents, told by two sums of hashes, stands for them all
    beside = owners.select("i", "h", F.explode("entities").alias("entity"))
    sets = beside.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.bit_xor(F.xxhash64("i", "h")).alias("s1"), F.bit_xor(F.xxhash64("h", "i")).alias("s2"))
    own = beside.join(sets, "entity").select("i", "h", "s1", "s2", "n_entity").distinct().groupBy("i", "h").agg(F.collect_list(F.struct("s1", "s2", "n_entity")).alias("sets"))
    owners = scratch.keep(owners.join(own, ["i", "h"]).select("i", "h", "sets", "rest", _hashed(_words(F.col("rest"))).alias("terms")))
    pairs = owners.select("i", "h", "sets", F.explode("terms").alias("term")).select("i", "h", "term", F.explode("sets").alias("s")).select("i", "h", "term", "s.*")
    both = pairs.groupBy("s1", "s2", "term").agg(F.count(F.lit(1)).alias("n_both"), F.max("n_entity").alias("n_entity"))
    keys = found.groupBy("i", "h").agg(F.count(F.lit(1)).alias("m"))
    n = keys.count()
    told = both.join(_documents_with(scratch, slim, keys), "term")
    total, more = F.lit(float(n + 2 * SMOOTH)), F.lit(SMOOTH)
    share = F.log(total * (F.col("n_both") + more) / ((F.col("n_term") + more) * (F.col("n_entity") + more))) / F.log(total / (F.col("n_entity") + more))
    told = scratch.keep(told.where(share >= discloses).select("s1", "s2", "term"))
    mine = pairs.join(told, ["s1", "s2", "term"], "left_semi").select("i", "h", "term").distinct()
    places = owners.select("i", "h", F.explode(_word_places(F.col("rest"))).alias("w")).select("i", "h", "w.*", F.xxhash64(F.lower("w.form")).alias("term"))
    places = places.join(mine, ["i", "h", "term"], "left_semi")
    terms = places.groupBy("i", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.lower("form").alias("value")))).alias("terms"))  # words of one document
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    plain = found.where(F.size("base") == 0).select("id", "base", none.alias("terms"), F.col("raw").alias("text"))
    rich = found.where(F.size("base") > 0).join(terms, ["i", "h"], "left").select("id", "base", F.coalesce("terms", none).alias("terms"), F.col("raw").alias("text"))
    return plain.union(rich)


def _documents_with(scratch: Scratch, slim: DataFrame, keys: DataFrame) -> DataFrame:
    """``(term, n_term)``: documents, rows equal in id and text being one, that hold a term.

    All rows are counted where they are read; what rows that ``keys`` counts
    more than once have added too much is taken off again, so that no text and
    no list of words is shuffled for the sake of repeats.
    """
    words = lambda df: df.select("i", "h", _hashed(_words(_unmatched(F.col("text")))).alias("words"))
    every = words(slim).select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    often = scratch.keep(keys.where("m > 1"))
    if often.isEmpty():
        return every.withColumnRenamed("n", "n_term")
    again = words(slim.join(often, ["i", "h"], "left_semi")).groupBy("i", "h").agg(F.first("words").alias("words")).join(often, ["i", "h"])
    more = again.select(F.explode("words").alias("term"), (F.col("m") - 1).alias("m")).groupBy("term").agg(F.sum("m").alias("more"))
    return every.join(more, "term", "left").select("term", (F.col("n") - F.coalesce("more", F.lit(0))).alias("n_term"))


def _generalised(text: Column, base: Column, terms: Column) -> Column:
    """The text with its spans replaced; spans that overlap give one replacement, the first one's."""
    named = lambda kind, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"))
    every = F.array_sort(F.concat(
        F.transform(base, lambda s: named(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")), s)), F.transform(terms, lambda s: named(F.lit(TERM), s))))

    def cut(pieces: Column) -> Column:
        def joined(e: Column) -> Column:
            reached = let(F.transform(e, lambda s: s["end"]), lambda ends: _so_far(ends, F.greatest))
            kept = F.zip_with(e, reached, lambda s, at: F.when(s["start"] >= at, F.concat(_between(pieces, at, s["start"]), s["kind"])).otherwise(""))
            last = F.array_max(F.transform(e, lambda s: s["end"]))
            return F.concat(F.array_join(kept, ""), _between(pieces, last, F.char_length(text)))

        return let(every, joined)

    return F.when(F.size(base) + F.size(terms) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1)), cut))


def sanitised(found: DataFrame) -> DataFrame:
    """``detect``'s rows with a column ``sanitised``: the whole text, matched values and disclosing terms generalised; null where nothing is."""
    return found.withColumn("sanitised", F.when(F.size("base") > 0, _generalised(F.col("text"), F.col("base"), F.col("terms"))))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", discloses: float = DISCLOSES) -> DataFrame:
    """``(id, text)`` of every row: its text with each matched value replaced by its kind and each disclosing term by ``TERM``; null stays null."""
    raw = F.col(f"`{text_col}`").cast("string")
    marked = F.translate(F.coalesce(raw, F.lit("")), MARK, MARK_AS)
    clean = df.select(F.col(f"`{id_col}`").alias("id"), raw.alias("text")).where(F.size(F.concat(*[spans(marked, k) for k in KINDS])) == 0)
    return sanitised(detect(df, id_col, text_col, discloses).where(F.size("base") > 0)).select("id", F.col("sanitised").alias("text")).union(clean)


def digests(found: DataFrame) -> DataFrame:
    """Counts, the base spans' SHA-256 and all spans written out; the sanitised text too if it is there."""
    written = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    extra = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("id", *map(n, KINDS), F.sha2(F.array_join(written, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(written, extra), ",").alias("spans"), *(["sanitised"] if "sanitised" in found.columns else []))
