import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import passages
from millrace.llm.chunks import packed
from millrace.sources.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_definition(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def removed(spark, texts, window=35, **more):
    df = spark.createDataFrame([(i, t, 5, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, chunk long, h string, n_words int")
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in passages.without_passages(df.repartition(5), window=window, **more).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("period", passages.PERIODS)
def test_each_difference_has_an_aligned_place(period):
    cover = passages.difference_cover(period)
    for d in range(period):
        assert any((c + d) % period in cover for c in cover)
    assert len(cover) * (len(cover) - 1) == period - 1


@pytest.mark.parametrize("window", [1, 2, 5, 12, 35])
def test_drawn_texts_against_the_definition(spark, window):
    rng = random.Random(window)
    base = [rng.choice("abc") for _ in range(400)]
    noise = lambda: [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
    texts = []
    for _ in range(100):
        a, n = rng.randrange(380), rng.randrange(1, 90)
        texts.append(" ".join(noise() + base[a : a + n] + noise()))
    texts += [None, "", " \n", "a " * 300, "z " * 35, "y " * 36, "b", "b"]
    assert removed(spark, texts, window) == by_definition(texts, window)


def test_small_chunks_find_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], by_definition([r.text for r in rows], 35), strict=True))
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in passages.without_passages(docs, chunk_bytes=20_000).collect()}
    assert got == want and any(n for _, n, _ in want.values())


def test_edges_of_a_passage_long_texts_and_other_white_space(spark):
    passage = [f"p{i}" for i in range(34)]
    texts = [" ".join(["x", *passage]), " ".join(["y", *passage]), " ".join(["x", *passage, "q"]), "\t\v\f\r\n".join(["é ", *passage, "q", "r"]), " ".join(f"w{i}" for i in range(60_000)), " ".join(f"w{i}" for i in range(59_965, 70_000))]
    got = removed(spark, texts)
    assert got == by_definition(texts, 35)
    assert [n for _, n, _ in got] == [35, 0, 36, 35, 35, 35]


def test_nulls_repeats_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None), (None, None), (3, "short")], "doc_id int, text string")
    got = sorted(map(tuple, passages.without_passages(df).collect()), key=str)
    assert got == sorted([(None, 40, 40, ""), (1, 40, 40, ""), (1, 40, 40, ""), (2, 0, 0, ""), (None, 0, 0, ""), (3, 1, 0, "short")], key=str)
    assert passages.without_passages(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        passages.without_passages(df, window=0)


def test_a_pass_holds_little_for_each_word():
    rng = random.Random(3)
    names = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(rng.choices(names, k=1_000)).encode() for _ in range(300)]
    texts += texts[:100]
    n = 1_000 * len(texts)
    lengths, body = packed(texts)
    row = pa.table({"chunk": [7], "ids": [list(range(len(texts)))], "lengths": [lengths], "body": [body]})
    first = passages._first_keys(35)(row)
    asked = pa.table({"chunk": first.column("chunk"), "h": first.column("h"), "lead": pa.array([True] * len(first))})
    windows = passages._window_keys(35)(row, asked)
    again = windows.filter(windows.column("many")).select(["chunk", "h", "h2"])

    def peak(run):
        tracemalloc.start()
        try:
            run()
            return tracemalloc.get_traced_memory()[1] / n
        finally:
            tracemalloc.stop()

    for run in (lambda: passages._first_keys(35)(row), lambda: passages._window_keys(35)(row, asked), lambda: passages._kept(35)(row, again)):
        assert peak(run) < 100
    assert max(b.num_rows for b in windows.to_batches()) <= passages.SENT_ROWS < windows.num_rows
    assert passages._kept(35)(row, again).column("n_removed").to_pylist() == [1_000] * 100 + [0] * 200 + [1_000] * 100


def test_pairs_of_equal_first_members():
    known_a, known_b = np.array([1, 4, 4, 4, 9]), np.array([5, 8, 2, 6, 1])
    a, b = np.array([4, 4, 4, 4, 1, 1, 9, 9, 0, 10]), np.array([8, 2, 6, 7, 5, 6, 1, 2, 5, 1])
    assert passages._pairs_in(a, b, known_a, known_b).tolist() == [True, True, True, False, True, False, True, False, False, False]
    assert passages._pairs_in(a, b, known_a[:0], known_b[:0]).tolist() == [False] * 10


def test_large_values_are_pages_of_their_own(spark):
    rows = spark.range(5, numPartitions=1).selectExpr("id AS chunk", "cast(repeat(cast(id AS string), 2000000) AS binary) AS body")
    scratch = Scratch(spark, "pages")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for kept in (scratch.keep_by(rows, "chunk", 1), scratch.keep(rows, large=True)):
        (file,) = kept.inputFiles()
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
        try:
            body = reader.getFooter().getBlocks().get(0).getColumns().get(1)
            assert reader.readOffsetIndex(body).getPageCount() >= 5
        finally:
            reader.close()
