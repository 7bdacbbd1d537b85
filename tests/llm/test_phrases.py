import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from millrace.llm import phrases
from millrace.llm.chunks import packed_numbers, unpacked_numbers

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def by_definition(rows, most_words=4, least=30, keep=2000, covered=80):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most_words + 1):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in found.items():
            for m in range(2, len(p)):
                inside.update(p[s : s + m] for s in range(len(p) - m + 1) if 100 * a >= covered * f[p[s : s + m]])
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:keep], 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(df, **more).collect())


def drawn(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "B", "c-c", "Éa", "d" * 40, "x y", "1"]
    mark = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]
    rows = []
    for _ in range(n):
        text = "".join(rng.choices(words, [9, 6, 4, 3, 2, 1, 1])[0] + rng.choices(mark, [30, 3, 3, 2, 2, 1, 1, 1])[0] for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("fr", "one two"), ("en", "  . ,")]


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, t, 3, "clash", 4) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, chunk long, word string, n int").repartition(4)


def test_drawn_texts_against_the_definition(spark):
    rows = drawn(1)
    want = by_definition(rows, least=5)
    assert len(want) > 50 and any(" ".join(["a"] * 4) == w[2] for w in want)
    assert mined(frame(spark, rows), least=5) == want


def test_small_chunks_few_kept_and_longer_phrases(spark):
    rows = drawn(2)
    want = by_definition(rows, most_words=5, least=3, covered=60)
    assert max(len(w[2].split(" ")) for w in want) == 5 and len(want) > 50
    assert mined(frame(spark, rows), most_words=5, least=3, covered=60, held_bytes=500) == want
    assert mined(frame(spark, rows), most_words=5, least=3, covered=60, keep=7) == by_definition(rows, most_words=5, least=3, covered=60, keep=7)


def test_given_documents_against_the_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert mined(docs, least=12) == by_definition(rows, least=12)


def test_long_text_repeats_and_empty_table(spark):
    rows = [("en", "q r s " * 50_000), *[("en", "t u")] * 40, (None, None)]
    df = frame(spark, rows)
    got = mined(df)
    assert got == by_definition(rows)
    assert {g[2]: g[3] for g in got}["t u"] == 40
    assert mined(df.limit(0)) == [] and mined(df.where("text is null")) == []


def test_counts_beyond_64_bits_in_products(spark):
    # the score's expression on counts whose product with 2000000 needs more than 64 bits
    a, down = 9_000_000_000_000_000, 18_000_000_000_000_001
    got = spark.range(1).selectExpr(f"(cast({a}L as decimal(20,0)) * cast(2000000 as decimal(7,0))) div cast({down}L as decimal(21,0)) as s").first().s
    assert got == 2000000 * a // down


class Caught:
    """Stands for a frame and keeps the function that a task would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def word_rows(monkeypatch, rows, held_bytes=phrases.HELD_BYTES):
    monkeypatch.setattr(phrases, "new_chunk", lambda n: n)
    batches = (pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([text.encode()])], names=["lang", "text"]) for lang, text in rows)
    return phrases._word_relation(Caught(), "lang", "text", held_bytes).run(batches)


def test_a_task_holds_little_besides_the_codes_of_its_words(spark, monkeypatch):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(20_000)}" for _ in range(25_000)) + "."
    for rows in ([("en", text)] * 60, [("en", text * 60)]):
        tracemalloc.start()
        (row,) = word_rows(monkeypatch, rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(row.column("counts")[0].as_py()) == 60 * 25_000
        assert peak < 5 * 60 * len(text)  # taken apart at once, about 20 bytes for each of text


def test_texts_cut_at_any_step_give_the_same_words(spark, monkeypatch):
    rows = [(lang or "und", text or "") for lang, text in drawn(4, 120)] + [("en", "x" * 300 + ". y y"), ("en", "..")]

    def pieces(row):
        words = row.column("words")[0].as_py()
        said = [words[c - 1] if c else None for c in unpacked_numbers(row.column("body")[0].as_py()).tolist()]
        out = [[]]
        for w in said:
            out[-1].append(w) if w is not None else out.append([])
        return row.column("lang")[0].as_py(), [p for p in out if p], dict(zip(words, row.column("counts")[0].as_py(), strict=True))

    for step in (1, 2, 7, 64, 1 << 20):
        monkeypatch.setattr(phrases, "STEP_BYTES", step)
        got = {lang: (found, counts) for lang, found, counts in map(pieces, word_rows(monkeypatch, rows))}
        assert set(got) == {lang for lang, _ in rows}
        for lang, (found, counts) in got.items():
            texts = "\n".join(text for x, text in rows if x == lang).translate(FOLD)
            want = [p for p in (re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", texts)) if p]
            assert found == want and counts == Counter(w for p in want for w in p)


def test_joins_by_stretches_of_places(monkeypatch):
    rng = np.random.default_rng(5)
    for size, groups in ((0, 0), (1, 3), (2, 3), (500, 12)):
        codes, gids = rng.integers(0, groups + 1, size), rng.permutation(1000)[:groups]
        ends = pa.array([0, groups], pa.int32())
        relation = pa.table({"chunk": pa.array([7]), "gids": pa.ListArray.from_arrays(ends, pa.array(gids, pa.int64())), "body": pa.array([packed_numbers(codes)], pa.binary())})
        both = [(int(gids[a - 1]), int(gids[b - 1])) if a and b else None for a, b in zip(codes[:-1], codes[1:], strict=True)]
        count = Counter(x for x in both if x)
        often = sorted(x for x, n in count.items() if n > 2)
        found = pa.table({"g1": pa.array([x for x, _ in often], pa.int64()), "g2": pa.array([x for _, x in often], pa.int64()), "gid": pa.array(range(50, 50 + len(often)), pa.int64())})
        for step, sent in ((1, 2), (2, 3), (7, 1000), (1 << 18, 1 << 16)):
            monkeypatch.setattr(phrases, "STEP_PLACES", step)
            monkeypatch.setattr(phrases, "SENT_ROWS", sent)
            joined = phrases._joined(relation)
            assert {(r["g1"], r["g2"]): r["n"] for r in joined.to_pylist()} == count and joined.num_rows == len(count)
            assert all(b.num_rows <= sent for b in joined.to_batches()) and set(joined.column("chunk").to_pylist()) <= {7}
            longer = phrases._longer(relation, found)
            own = longer.column("gids")[0].as_py()
            got = [own[c - 1] - 50 if c else None for c in unpacked_numbers(longer.column("body")[0].as_py()).tolist()]
            assert [often[g] if g is not None else None for g in got] == ([x if x in often else None for x in both] if often else [])
