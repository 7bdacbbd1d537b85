import random
import re
import zlib
from collections import Counter

from millrace.llm import spelling

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SMALL = "/root/testdata/sf0.001/documents.parquet"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counts(rows, shortest=7, least=2, every=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= shortest:
                n[word] += 1
    return {w: c for w, c in n.items() if c >= least}


def by_definition(n, times=10):
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    found = {}
    for w in n:
        others = [o for k in (len(w) - 1, len(w), len(w) + 1) for o in by_size.get(k, []) if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o)) if others else None
        form = best if best and n[best] >= times * n[w] else None
        found[w] = (len(others), form)
    out = {}
    for w, (k, form) in found.items():
        root = w
        while found[root][1]:
            root = found[root][1]
        out[w] = (n[w], k, form, n[form] if form else None, root)
    return out


def grouped(df, **more):
    rows = spelling.spelling_variants(df, **more).collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def test_drawn_words_against_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abÀ") for _ in range(rng.randrange(3, 7))) for _ in range(250)}
    rows = [(w, rng.choice([2, 3, 30, 300, 4000])) for w in sorted(words)]
    got = {r.word: (r.n_near, r.near_n, r.near) for r in spelling.near_words(spark.createDataFrame(rows, "word string, n long").repartition(3)).collect()}
    n = dict(rows)
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o)) if others else None
        assert got.get(w) == ((len(others), n[best], best) if best else None)


def test_given_documents_against_all_pairs(spark):
    docs = spark.read.parquet(SMALL)
    n = counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    want = by_definition(n)
    assert grouped(docs, every=31) == want
    assert any(form for _, _, form, _, _ in want.values())


def test_chains_of_forms_end_at_their_root(spark):
    chain = ["aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb", "aabbbbbb"]
    rows = [(i, " ".join([w] * (2 * 10**k)) + ".") for i, (k, w) in enumerate(enumerate(chain[:5]))]
    got = grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == by_definition(counts(rows, every=None))
    assert [got[w][4] for w in chain[:5]] == [chain[4]] * 5 and got[chain[0]][2] == chain[1]


def test_odd_rows(spark):
    text = "Straßen Straßes, Straßes; STRAßES naïvely×naïvely xĀabcdefg abcdefgh!"
    rows = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "short"), (5, "zzzzzzzz " * 30_000), (6, "zzzzzzz " * 3)]
    df = spark.createDataFrame([(i, t, "clash", 9, 1) for i, t in rows], "doc_id long, text string, word string, n int, prefix int")
    for every in (None, 1, 3, 31):
        assert grouped(df, every=every) == by_definition(counts(rows, every=every))
    assert grouped(df.limit(0)) == {} and grouped(df.where("text is null")) == {}


def test_rows_of_one_prefix_may_straddle_batches():
    import pyarrow as pa

    words = {f"aaaa{c}aaa": 10 + k for k, c in enumerate("abcdefgh")} | {"aaaaaaa": 5, "zzzzzzz": 3}
    rows = sorted((w[i + 1 :] + "$" + w[:i], w[i], n) for w, n in words.items() for i in range(len(w)))
    rows = sorted(rows + [(w[i:] + "$" + w[:i], "", n) for w, n in words.items() for i in range(len(w) + 1)])
    batches = [pa.RecordBatch.from_pylist([dict(zip(("prefix", "last", "n"), r, strict=True)) for r in rows[k : k + 2]]) for k in range(0, len(rows), 2)]
    total = Counter()
    for b in spelling._scan(iter(batches)):
        for r in b.to_pylist():
            total[r["word"]] += r["n_near"]
    assert total == {w: k for w in words if (k := sum(near(w, o) for o in words))}
