"""What the models decide, against plain definitions of theirs."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from millrace.llm import secrets, url_filter

SMALL = "/root/testdata/sf0.001"


def best_path_score(field, text, tokens):
    """Emissions by the definition of the features, and the best score of all label paths."""
    f = [secrets.token_features(t) for t in tokens]
    e = np.zeros((len(tokens), 3))
    for t in range(len(tokens)):
        buckets = [*f[t][: secrets.OWN], secrets.file_feature(text)]
        buckets += [f[t - k][secrets.OWN - 1 + k] for k in (1, 2, 3) if t >= k] + ([f[t + 1][secrets.OWN + 3]] if t + 1 < len(tokens) else [])
        e[t] = field.weights[buckets].sum(axis=0)

    def score(path):
        return sum(e[t, y] for t, y in enumerate(path)) + sum(field.moves[a, b] for a, b in itertools.pairwise(path))

    return score, max(map(score, itertools.product(range(3), repeat=len(tokens))))


@pytest.mark.parametrize("outside", [0.0, 1.0, 3.0])
def test_viterbi_path_is_the_best_of_all_paths(outside):
    rng = np.random.default_rng(int(outside * 10) + 1)
    words = ["token", "=", "x9Kq", "the", ":", "value", "abc", "0f0f0f", "key", "Zz"]
    tagged = 0
    for _ in range(40):
        weights = rng.normal(0, 0.6, (secrets.BUCKETS, 3))
        weights[:, secrets.O] += 2 * outside / secrets.SLOTS
        field = secrets.Field(weights, rng.normal(0, 0.8, (3, 3)))
        text = " ".join(rng.choice(words, int(rng.integers(1, 8))))
        tokens = secrets.TOKEN.findall(text)
        _, y = field.labels(text, tokens)
        score, best = best_path_score(field, text, tokens)
        assert score(y.tolist()) == pytest.approx(best, abs=1e-9)
        tagged += bool(y.any())
    assert tagged > 5


class PlainModel:
    """The blended estimate by its definition, from a count of each context's successors."""

    def __init__(self, urls):
        self.next = Counter()
        for codes in urls:
            for t in range(url_filter.ORDER, len(codes)):
                for k in range(url_filter.ORDER + 1):
                    self.next[codes[t - k : t], codes[t]] += 1
        self.seen, self.kinds = Counter(), Counter()
        for (context, _), n in self.next.items():
            self.seen[context] += n
            self.kinds[context] += 1

    def chance(self, context, code):
        below = 1 / url_filter.SIZE if not context else self.chance(context[1:], code)
        d = max(self.kinds[context], 1)
        return (self.next[context, code] + d * below) / (self.seen[context] + d)


def plain_codes(url):
    """Starts, then letters and marks by place, digits as one and all other bytes as one."""
    out = ["^"] * url_filter.ORDER
    for byte in url.split("://", 1)[-1].encode():
        c = chr(byte).lower() if byte < 128 else "?other"
        out.append(c if c in url_filter.LETTERS else "0" if c.isdigit() else "?other")
    return tuple(out)


def test_url_scores_and_cut_equal_their_definition(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    urls = {r.page_id: r.url for r in pages.collect()}
    rows = url_filter.judge(pages).collect()
    fifth = {i: np.int64(np.uint64(xxhash.xxh64_intdigest(u.encode(), 42))) % 5 == 0 for i, u in urls.items() if u is not None}
    learnt = {v: [plain_codes(urls[r.id]) for r in rows if r.rule and r.verdict == v and not fifth[r.id]] for v in ("allow", "block")}
    allow, block = PlainModel(learnt["allow"]), PlainModel(learnt["block"])
    for r in rows:
        codes = plain_codes(urls[r.id] or "")
        steps = [(codes[t - url_filter.ORDER : t], codes[t]) for t in range(url_filter.ORDER, len(codes))]
        plain = sum(math.log(allow.chance(*s)) - math.log(block.chance(*s)) for s in steps) / len(steps) if steps else 0.0
        assert r.score == pytest.approx(plain, abs=1e-4)

    free = [r for r in rows if not r.rule]
    low = max([r.score for r in free if r.verdict == "block"], default=-math.inf)
    high = min([r.score for r in free if r.verdict == "allow"], default=math.inf)
    assert low < high  # one cut
    held = [r for r in rows if r.rule and fifth[r.id]]

    def both(cut):
        share = [[(r.score >= cut) == (v == "allow") for r in held if r.verdict == v] for v in ("allow", "block")]
        return sum(sum(s) / len(s) for s in share)

    # the cut lies in (low, high]; of the shares found there, the best is the best of all, but for one bin's rows
    inside = [low, *[r.score for r in held if low <= r.score < high]]
    candidates = [c + 1e-6 for c in inside if math.isfinite(c)] + ([high] if math.isfinite(high) else [])
    assert max(map(both, candidates)) >= max(both(r.score + d) for r in held for d in (0, 1e-6)) - 0.02


def test_the_field_finds_secrets_that_no_pattern_names_and_leaves_text_alone(spark):
    import random

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()
    rng = random.Random(7)
    texts = [r.text for r in rows if r.text and not secrets.base_spans(r.text)]
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))

    def planted(text, what):
        at = rng.randrange(len(text) + 1)
        at = text.find(" ", at)
        return f"{text} {what}" if at < 0 else f"{text[:at]} {what}{text[at:]}"

    learnt = [planted(t, f'{rng.choice(["token", "api_key", "secret"])} {rng.choice("=:")} "{hexes()}"') if i % 2 else t for i, t in enumerate(texts[:100])]
    x, y, groups = [], [], []
    for i, t in enumerate(learnt):
        for f, labels in secrets.training_windows(t):
            x.append(f), y.append(labels), groups.append(i)
    field = secrets.train(np.array(x).reshape(len(x), -1, secrets.SLOTS), np.array(y), np.array(groups))
    alphabet = secrets.ALNUM
    found = planted_ = false = words = 0
    for i, t in enumerate(texts[100:]):
        secret = "".join(rng.choice(alphabet) for _ in range(rng.randrange(16, 30)))
        form = rng.choice(["pwd: {}", 'auth = "{}"', "credential={}", "bearer : {}", "private_key = sk_{}"])
        what = form.format(secret)
        if i % 2 and sum(a.isdigit() != b.isdigit() for a, b in zip(secret, secret[1:])) >= 4:
            t = planted(t, what)
            planted_ += 1
        spans = [t[a:b] for a, b in field.extra(t, secrets.base_spans(t))]
        hit = [s for s in spans if secret in s]
        found += bool(hit)
        false += len(spans) - len(hit)
        words += len(t.split())
    assert planted_ > 20 and found >= 0.9 * planted_ and false <= words / 20_000


def test_caution_and_held_out_windows():
    w = np.zeros((secrets.BUCKETS, 3))
    field = secrets.Field(w, np.zeros((3, 3)))
    wary = secrets.cautious(field, 2.0)
    assert wary.weights[secrets.file_feature("a = 1"), secrets.O] == 2.0 and not w.any()
    none = secrets.train(np.zeros((4, 17, secrets.SLOTS), dtype=np.int64), np.zeros((4, 17), dtype=np.int8))
    assert none.extra("token = abcdef123456", []) == []


def test_second_windows_hide_the_key_and_respell_the_secret():
    text = "lorem ipsum dolor sit amet token = 04dbebab91ab85687d33eeaaf9ac699e1188f962 consectetur"
    plain, other = secrets.training_windows(text)
    assert plain[1] == other[1] and plain[0] != other[0]
    assert secrets.respelt("abc") == secrets.respelt("abc") != secrets.respelt("abd") and 12 <= len(secrets.respelt("abc")) <= 32
    assert len(secrets.training_windows("no secret here")) <= secrets.WINDOWS and secrets.training_windows("") == []
