"""Secrets: pattern spans, and further spans tagged by a linear-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, small_batches

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
KINDS = ("assign", "access", "hex")
#: Words with what base 64 pads them with, or single marks.
TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+(?:={1,2}(?![A-Za-z0-9+/_.=-]))?|[^\sA-Za-z0-9+/_.-]")
#: Words after which the patterns look for a secret.
KEY = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)

#: Buckets of hashed features, feature slots of a token, tokens on either side in a training window.
BUCKETS, SLOTS, REACH = 1 << 14, 9, 8
#: Slots of a token that are of itself.
OWN = 4
#: Texts with and without a pattern span that the field is fitted on at most, least hash first.
SAMPLE = 500
WINDOWS = 6
STEPS, RATE = 60, 0.3
#: Penalties and biases towards outside that are tried.
PENALTIES, CAUTION = (1e-5, 1e-3), (0.0, 1.0, 2.0, 4.0)
O, B, I = 0, 1, 2  # noqa: E741
REMEMBERED = 1 << 17
HIDDEN = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's place, end, start of the secret itself) by start, then kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


@lru_cache(1 << 14)
def _bucket(slot: str, value: str) -> int:
    return zlib.crc32(f"{slot}:{value}".encode("utf-8", "surrogatepass")) % BUCKETS


#: Checksums of the slots that hold neighbours, carried on over the neighbour itself.
NEAR = tuple(zlib.crc32(f"{slot}:".encode()) for slot in ("p1", "p2", "p3", "n1"))


def shape(token: str) -> str:
    """Kinds of characters, how often they alternate and how long the token is, each in steps."""
    if token.isascii() and token.isalpha() and (token.islower() or token.isupper()):
        sorts, turns = "a" if token.islower() else "A", 0
    else:
        kinds = [("a" if c.islower() else "A") if c.isalpha() else "0" if c.isdigit() else "-" for c in token]
        sorts, turns = "".join(sorted(set(kinds))), sum(map(ne, kinds, kinds[1:]))
    return f"{sorts}{min(turns, 6)}{min(len(token), 48).bit_length()}{int(len(token) > 15)}"


def mixture(token: str) -> str:
    """How often letters and digits take turns, in steps, and whether the token is long enough for a key; whatever the letters' case."""
    if token.isalpha() or not any(c.isdigit() for c in token):
        return "word"
    kinds = [c.isdigit() for c in token if c.isalnum()]
    return f"{min(sum(map(ne, kinds, kinds[1:])), 5)}{min(len(token) // 6, 3)}"


def token_features(token: str) -> tuple[int, ...]:
    """Buckets as the token itself (four), as the last, second and third last one, and as the next."""
    word = token.lower() if len(token) <= 24 else "long"
    s = shape(token)
    distinct = len(set(token))
    own = (_bucket("shape", s), _bucket("distinct", f"{min(distinct, 20)}/{min(len(token), 40) // 4}"), _bucket("plain", str(token.isalpha()) + s[-1]), _bucket("mixed", mixture(token)))
    mark = (word if word.isalpha() or not any(c.isdigit() for c in word) else s).encode("utf-8", "surrogatepass")
    return (*own, *[zlib.crc32(mark, near) % BUCKETS for near in NEAR])


def file_feature(text: str) -> int:
    """One bucket of the whole text: share of digits and of assignment marks, in steps."""
    n = max(len(text), 1)
    marks = text.count("=") + text.count(":") + text.count('"')
    return _bucket("file", f"{min(9, marks * 400 // n)}")


@dataclass
class Field:
    weights: np.ndarray  # (BUCKETS, 3)
    moves: np.ndarray  # (3, 3)

    def __post_init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, 5, 3))  # as the token itself, and as the four neighbours
        m = self.moves
        into = lambda y: [m[a, y] - m[a, O] for a in (O, B, I)] + [0.0]  # noqa: E731  the last: a text's first token
        out = lambda y: [m[y, b] - m[O, b] for b in (O, B, I)] + [0.0]
        self.slack = np.array([max(into(y)) + max(out(y)) for y in (B, I)])

    def _learn(self, tokens: set[str]) -> None:
        """Remember what each of these tokens adds to its own and its neighbours' labels."""
        f = np.array([token_features(t) for t in tokens], dtype=np.int64)
        first, end = len(self.at), len(self.at) + len(f)
        if end > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((end, 5, 3))))
        self.rows[first:end, 0] = self.weights[f[:, :OWN]].sum(axis=1)
        self.rows[first:end, 1:] = self.weights[f[:, OWN:]]
        self.at.update(zip(tokens, range(first, end), strict=True))

    def labels(self, text: str, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places not surely outside, and the best path's labels of all tokens (Viterbi).

        Where outside beats a label by more than the moves from and to any
        neighbours can return, no best path has that label there; only the
        stretches where one is left are searched.
        """
        if len(self.at) >= REMEMBERED:
            self.at.clear()
        if new := {t for t in tokens if t not in self.at}:
            self._learn(new)
        ids = np.array([*map(self.at.__getitem__, tokens)], dtype=np.int64)
        n = len(ids)
        e = self.rows[ids, 0] + self.weights[file_feature(text)]
        for k, slot in ((1, 1), (2, 2), (3, 3)):
            e[k:] += self.rows[ids[: max(n - k, 0)], slot]
        e[:-1] += self.rows[ids[1:], 4]
        out = np.zeros(n, dtype=np.int8)
        open_ = np.flatnonzero((e[:, :1] - e[:, 1:] <= self.slack).any(axis=1))
        if len(open_):
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                lo, hi = int(run[0]), int(run[-1]) + 1
                best = e[lo] + (self.moves[O] if lo else 0.0)
                back = []
                for t in range(lo + 1, hi):
                    all_ = best[:, None] + self.moves
                    back.append(all_.argmax(axis=0))
                    best = all_.max(axis=0) + e[t]
                if hi < n:
                    best = best + self.moves[:, O]
                y = int(best.argmax())
                out[hi - 1] = y
                for t in range(hi - 2, lo - 1, -1):
                    y = int(back[t - lo][y])
                    out[t] = y
        return open_, out

    def extra(self, text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
        """Tagged spans that share no character with a pattern span."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        _, y = self.labels(text, tokens)
        if not y.any():
            return []
        spans: list[list[int]] = []
        before = O
        for m, k in zip(TOKEN.finditer(text), y.tolist(), strict=True):
            if k == B or (k == I and before == O):
                spans.append([m.start(), m.end()])
            elif k == I:
                spans[-1][1] = m.end()
            before = k
        out, i = [], 0
        ends = sorted((s, e) for s, _, e, _ in base)
        for s, e in spans:
            while i < len(ends) and ends[i][1] <= s:
                i += 1
            if all(b >= e or f <= s for b, f in ends[i : i + 4]):
                out.append((s, e))
        return out


def respelt(secret: str) -> str:
    """Other characters of one of three alphabets, drawn by the secret's digest."""
    digest = hashlib.sha256(secret.encode("utf-8", "surrogatepass")).digest()
    letters = (ALNUM, ALNUM[26:], ALNUM[:26] + ALNUM[52:])[digest[0] % 3]
    drawn = "".join(letters[b % len(letters)] for b in digest[2 : 14 + digest[1] % 19])
    return drawn if digest[0] & 64 else f"{drawn[:2].lower()}_{drawn[2:]}"


def training_windows(text: str, most: int = WINDOWS) -> list[tuple[list[int], list[int]]]:
    """(feature buckets, labels) of stretches around pattern spans, or spread evenly without any.

    Where a pattern's key word precedes the secret, the stretch comes a second
    time with another word of the text in the key's place and the secret spelt
    in another alphabet, so that the field learns what secrets look like after
    keys, and in forms, that no pattern names.
    """
    tokens = [(m.start(), m.group()) for m in TOKEN.finditer(text)]
    if not tokens:
        return []
    n = len(tokens)
    y = np.zeros(n, dtype=np.int8)
    starts = np.array([at for at, _ in tokens])
    for _, _, end, at in base_spans(text):
        lo, hi = np.searchsorted(starts, at), np.searchsorted(starts, end)
        if lo < hi and not y[lo:hi].any():
            y[lo], y[lo + 1 : hi] = B, I
    mid = np.flatnonzero(y == B)
    if not len(mid):
        mid = np.unique(np.linspace(0, n - 1, most).astype(int))
    mid = mid[np.unique(np.linspace(0, len(mid) - 1, min(most, len(mid))).astype(int))]
    doc, none, out = file_feature(text), _bucket("edge", ""), []

    def window(c: int, named: dict[int, str]) -> tuple[list[int], list[int]]:
        feats = {i: token_features(named.get(i, tokens[i][1])) for i in range(max(0, c - REACH - 3), min(n, c + REACH + 2))}
        near = lambda i, slot: feats[i][slot] if i in feats else none
        rows, labels = [], []
        for i in range(c - REACH, c + REACH + 1):
            here = 0 <= i < n
            rows += [*feats[i][:OWN], *(near(i + d, OWN + k) for k, d in enumerate((-1, -2, -3, 1))), doc] if here else [none] * SLOTS
            labels.append(int(y[i]) if here else O)
        return rows, labels

    for c in mid.tolist():
        out.append(window(c, {}))
        keys = [i for i in range(max(0, c - 3), c) if KEY.search(tokens[i][1])] if y[c] == B else []
        if keys:
            words = [w for k in range(min(n, 64)) if (w := tokens[(c * 31 + k * 7) % n][1]).isalpha() and not KEY.search(w)]
            out.append(window(c, dict.fromkeys(keys, words[0] if words else "x") | {c: respelt(tokens[c][1])}))
    return out


_norm = lambda x: np.log(np.exp(x - x.max(axis=-1, keepdims=True)).sum(axis=-1)) + x.max(axis=-1)


def _fitted(features: np.ndarray, labels: np.ndarray, penalty: float) -> Field:
    """Weights of greatest penalised likelihood over windows (n, tokens, slots) and (n, tokens)."""
    w, m = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    n, length, slots = features.shape
    flat = features.reshape(-1)
    one = np.eye(3)[labels]
    seen = np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:])
    gw, gm = np.full_like(w, 1e-8), np.full_like(m, 1e-8)
    for _ in range(STEPS):
        e = w[features].sum(axis=2)
        a, b = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        a[:, 0] = e[:, 0]
        for t in range(1, length):
            a[:, t] = e[:, t] + _norm(np.swapaxes(a[:, t - 1, :, None] + m, 1, 2))
        for t in range(length - 2, -1, -1):
            b[:, t] = _norm(m + (e[:, t + 1] + b[:, t + 1])[:, None, :])
        z = _norm(a[:, -1])[:, None, None]
        node = np.exp(a + b - z)
        edge = np.exp(a[:, :-1, :, None] + m + (e + b)[:, 1:, None, :] - z[..., None]).sum(axis=(0, 1))
        d = np.repeat((node - one).reshape(-1, 3), slots, axis=0)
        dw = np.stack([np.bincount(flat, weights=d[:, k], minlength=BUCKETS) for k in range(3)], axis=1) / n + penalty * w
        dm = (edge - seen) / n + penalty * m
        gw, gm = gw + dw**2, gm + dm**2
        w, m = w - RATE * dw / np.sqrt(gw), m - RATE * dm / np.sqrt(gm)
    return Field(w, m)


def best_paths(field: Field, features: np.ndarray) -> np.ndarray:
    """The best path's labels of each window, all windows at once."""
    e = field.weights[features].sum(axis=2)
    best, back = e[:, 0], []
    for t in range(1, e.shape[1]):
        all_ = best[:, :, None] + field.moves
        back.append(all_.argmax(axis=1))
        best = all_.max(axis=1) + e[:, t]
    y = [best.argmax(axis=1)]
    for step in reversed(back):
        y.append(np.take_along_axis(step, y[-1][:, None], axis=1)[:, 0])
    return np.stack(y[::-1], axis=1)


def cautious(field: Field, bias: float) -> Field:
    """The field with ``bias`` more for outside, on the feature that each token of a file has."""
    weights = field.weights.copy()
    weights[[_bucket("file", str(k)) for k in range(10)], O] += bias
    return Field(weights, field.moves)


def train(features: np.ndarray, labels: np.ndarray, groups: np.ndarray | None = None) -> Field:
    """The field of the penalty and caution that tag the windows held out best.

    A fifth of the ``groups`` (texts) is held out of the choice and learnt from
    in the end. A wrong tag weighs four times a missed one. Without a labelled
    secret nothing is tagged.
    """
    if not len(labels) or not (labels == B).any():
        w = np.zeros((BUCKETS, 3))
        w[:, O] = 10.0
        return Field(w, np.zeros((3, 3)))
    held = (np.arange(len(labels)) if groups is None else groups) % 5 == 0
    chosen = (PENALTIES[0], 0.0)
    if (labels[held] == B).any() and (labels[~held] == B).any():
        least = None
        for penalty in PENALTIES:
            field = _fitted(features[~held], labels[~held], penalty)
            for bias in CAUTION:
                tagged, true = best_paths(cautious(field, bias), features[held]) != O, labels[held] != O
                cost = 4 * (tagged & ~true).sum() + (true & ~tagged).sum()
                if least is None or cost < least:
                    least, chosen = cost, (penalty, bias)
    return cautious(_fitted(features, labels, chosen[0]), chosen[1])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """The field fitted on the pattern spans of at most ``sample`` texts with and as many without one."""
    small_batches(df.sparkSession)
    slim = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rough = F.col("text").rlike("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    scratch = Scratch(df.sparkSession, "secrets")
    marked = scratch.keep(slim.select(F.xxhash64("id", "text").alias("h"), rough.alias("hit")))  # the pattern runs once a text
    pick = lambda c: marked.where(c).select("h").distinct().orderBy("h").limit(sample)
    few = pick(F.col("hit")).union(pick(~F.col("hit")))  # at most twice ``sample`` hashes
    texts = slim.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(few), "h").select("h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, x, y = [], [], []
            for k, t in zip(b.column(0), b.column(1), strict=True):
                for rows, labels in training_windows(t.as_py()):
                    h.append(k.as_py())
                    x.append(np.array(rows, np.int16).tobytes())
                    y.append(np.array(labels, np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["h", "x", "y"])

    # equal rows come in equal windows; repeats are taken once, so copies do not outweigh the rest
    got = sorted({(r[0], bytes(r[1]), bytes(r[2])) for r in texts.mapInArrow(run, "h long, x binary, y binary").distinct().collect()})
    scratch.drop(marked)
    length = 2 * REACH + 1
    x = np.frombuffer(b"".join(r[1] for r in got), np.int16).astype(np.int64).reshape(-1, length, SLOTS)
    y = np.frombuffer(b"".join(r[2] for r in got), np.int8).reshape(-1, length)
    return train(x, y, np.array([r[0] & 0x7FFFFFFF for r in got], dtype=np.int64))


def scan(df: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans)`` of every whole text.

    A pattern span is the whole match. Null texts are empty and have no span;
    repeated rows each get a row; an empty table gives an empty result; extra
    columns are ignored. Tagged spans are written with kind ``crf``.
    """
    small_batches(df.sparkSession)
    field = field or fit(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast((field.weights, field.moves))  # 0.4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Field(*shared.value)
        for b in batches:
            counts: list[list[int]] = [[], [], []]
            sha, spans = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                written = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base]
                sha.append(hashlib.sha256(",".join(written).encode()).hexdigest())
                every = sorted([(s, k, e) for s, k, e, _ in base] + [(s, 3, e) for s, e in here.extra(text, base)])
                spans.append(",".join(f"{(*KINDS, 'crf')[k]}:{s}:{e}" for s, k, e in every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    long = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    return slim.mapInArrow(run, T.StructType([T.StructField("id", slim.schema["id"].dataType), *long, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]))


def hide(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], HIDDEN]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, field: Field | None = None) -> DataFrame:
    """The rows of ``df`` with the secrets in ``text`` replaced; ``n_chars``, if there, follows the text."""
    small_batches(df.sparkSession)
    field = field or fit(df)
    shared = df.sparkSession.sparkContext.broadcast((field.weights, field.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Field(*shared.value)
        for b in batches:
            out = []
            for t in b.column(b.schema.get_field_index("text")):
                text = t.as_py()
                base = base_spans(text or "")
                out.append(text and hide(text, [(at, e) for _, _, e, at in base] + here.extra(text, base)))
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))

    done = df.mapInArrow(run, df.schema)
    if "n_chars" in df.columns:
        kind = df.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done
