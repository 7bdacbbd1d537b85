"""Copies of images, cropped or edited, by local binary descriptors and geometric consensus."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hamming import links
from .shared import Scratch, components, named_components, small_batches

#: Bits of a descriptor, radius of the patch it tests, and bins of its turn.
BITS, RADIUS, TURNS = 256, 11, 32
#: Sides of a level and of the next smaller one; levels under ``LEAST_SIDE`` pixels are left out.
SHRINK, LEAST_SIDE = 1.4, 32
#: Pixels of a level for each of the strongest corners that are described on it, and share of the strongest that a corner must reach.
CORNER_AREA, FAINTEST = 48, 0.02
#: Bits in which a match differs at most.
MATCH = 40
#: Hamming tables, bits that each takes of a corner and of one of its neighbours, and neighbours that a corner is paired with.
TABLES, KEY_BITS, NEIGHBOURS = 8, 24, 3
#: Differences of direction (in 256ths of a turn) and of distance (in 16ths of an octave) that two pairs of corners of one key may have.
TURN_SLACK, STRETCH_SLACK = 16, 5
#: Matches of one shift, scale and turn that make two images copies.
CONSENSUS = 5
#: Rounds in which an image is compared with one other before all that is left is compared.
ROUNDS = 3
#: Images of a bucket that are paired in one piece.
CHUNK = 4096


def _pattern() -> np.ndarray:
    """(turn, bit, end, yx) offsets of the pixel pairs that are compared."""
    rng = np.random.default_rng(5)
    points = np.clip(rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS + 3, RADIUS - 3)
    points *= np.minimum(1, (RADIUS - 1) / np.maximum(np.hypot(points[..., 0], points[..., 1]), 1e-9))[..., None]
    turn = np.arange(TURNS) * 2 * np.pi / TURNS
    c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    y, x = points[None, ..., 0], points[None, ..., 1]
    return np.rint(np.stack([s * x + c * y, c * x - s * y], -1)).astype(np.int64)


PATTERN = _pattern()
_SIDE = np.arange(-RADIUS, RADIUS + 1)
DISC = np.argwhere(_SIDE[:, None] ** 2 + _SIDE[None, :] ** 2 <= RADIUS**2) - RADIUS


def _blur(x: np.ndarray) -> np.ndarray:
    for axis in (-2, -1):
        p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(2, 2) if a == axis else (0, 0) for a in (-2, -1)], mode="edge")
        n = x.shape[axis]
        cut = lambda k: p[..., k : k + n, :] if axis == -2 else p[..., k : k + n]  # noqa: B023, E731
        x = (cut(0) + cut(4) + 4 * (cut(1) + cut(3)) + 6 * cut(2)) / 16
    return x


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear samples of ``x(.., h, w)``."""
    def along(x: np.ndarray, n: int, axis: int) -> np.ndarray:
        old = x.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        low = np.minimum(at.astype(int), max(old - 2, 0))
        part = (at - low).astype(np.float32).reshape((-1, 1) if axis == -2 else (-1,))
        return np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, old - 1), axis) * part

    return along(along(x.astype(np.float32), height, -2), width, -1)


def describe(images: np.ndarray) -> dict[str, np.ndarray]:
    """Corners of ``images(n, h, w)`` of one size on all levels: image, y, x, scale, angle and bits (k, 32 bytes)."""
    out: dict[str, list] = {k: [] for k in ("image", "y", "x", "scale", "angle", "bits")}
    n, h, w = images.shape
    scale = 1.0
    while min(h / scale, w / scale) >= LEAST_SIDE:
        level = _blur(resized(images, round(h / scale), round(w / scale)) if scale > 1 else images.astype(np.float32))
        gy, gx = np.gradient(level, axis=(-2, -1))
        yy, xx, xy = _blur(gy * gy), _blur(gx * gx), _blur(gx * gy)
        strength = (yy * xx - xy * xy) / (yy + xx + 1e-6)
        inner = strength[:, RADIUS:-RADIUS, RADIUS:-RADIUS]
        ih, iw = inner.shape[-2:]
        peak = np.max([strength[:, RADIUS + a : RADIUS + a + ih, RADIUS + b : RADIUS + b + iw] for a in range(-2, 3) for b in range(-2, 3)], axis=0)
        top = strength.reshape(n, -1).max(axis=1)[:, None, None]
        img, y, x = np.nonzero((inner == peak) & (inner > FAINTEST * top) & (inner > 1e-3))
        if len(img):
            order = np.lexsort((x, y, -inner[img, y, x], img))
            first = np.searchsorted(img[order], img[order])
            keep = order[np.arange(len(order)) - first < max(1, level.shape[1] * level.shape[2] // CORNER_AREA)]
            img, y, x = img[keep], y[keep] + RADIUS, x[keep] + RADIUS
            patch = level[img[:, None], y[:, None] + DISC[:, 0], x[:, None] + DISC[:, 1]]
            patch = patch - patch.mean(axis=1, keepdims=True)
            angle = np.arctan2(patch @ DISC[:, 0].astype(np.float32), patch @ DISC[:, 1].astype(np.float32))
            turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
            ends = PATTERN[turn]
            value = level[img[:, None, None], y[:, None, None] + ends[..., 0], x[:, None, None] + ends[..., 1]]
            out["bits"].append(np.packbits(value[..., 0] < value[..., 1], axis=1))
            for k, v in (("image", img), ("y", (y + 0.5) * scale), ("x", (x + 0.5) * scale), ("scale", np.full(len(img), scale)), ("angle", angle)):
                out[k].append(v)
        scale *= SHRINK
    empty = {"image": np.empty(0, int), "bits": np.empty((0, BITS // 8), np.uint8)}
    return {k: np.concatenate(v) if v else empty.get(k, np.empty(0)) for k, v in out.items()}


def are_copies(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> bool:
    """Whether ``CONSENSUS`` matches, each corner in one of them at most, agree on a shift, scale and turn."""
    if min(len(a["y"]), len(b["y"])) < CONSENSUS:
        return False
    apart = np.bitwise_count(a["bits"].view(np.uint64)[:, None, :] ^ b["bits"].view(np.uint64)[None, :, :]).sum(axis=2, dtype=np.int64)
    # each is the other's nearest; corners of equal bits tie and all stay
    i, j = np.nonzero((apart <= MATCH) & (apart == apart.min(axis=1)[:, None]) & (apart == apart.min(axis=0)[None, :]))
    if len(i) < CONSENSUS:
        return False
    ratio = b["scale"][j] / a["scale"][i]
    turn = b["angle"][j] - a["angle"][i]
    here, there = a["x"][i] + 1j * a["y"][i], b["x"][j] + 1j * b["y"][j]
    # every match proposes a similarity; corners that it carries to their partners agree
    carried = (ratio * np.exp(1j * turn))[:, None] * (here[None, :] - here[:, None])
    agree = np.abs(carried - (there[None, :] - there[:, None])) <= 4 * np.maximum(1, ratio)[:, None]
    agree &= (np.abs(np.log(ratio[None, :] / ratio[:, None])) < 0.2) & (np.cos(turn[None, :] - turn[:, None]) > 0.9)
    for k in np.flatnonzero(agree.sum(axis=1) >= CONSENSUS):
        if all(len(np.unique((p[agree[k]].real // 3) * 1e6 + p[agree[k]].imag // 3)) >= CONSENSUS for p in (here, there)):
            return True
    return False


def decoded(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM or of an 8-bit PNG that is not interlaced; None for anything else."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            parts = data.split(maxsplit=4)
            w, h, most = int(parts[1]), int(parts[2]), int(parts[3])
            planes = 3 if data[:2] == b"P6" else 1
            at = data.index(parts[3], data.index(parts[2], data.index(parts[1], 2) + len(parts[1])) + len(parts[2])) + len(parts[3]) + 1
            raw = np.frombuffer(data, np.uint8, h * w * planes, at).reshape(h, w, planes)
            return raw.astype(np.float32).mean(axis=2) * (255 / most) if most < 256 else None
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, struct.error, zlib.error):
        return None
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, packed, head, palette = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    w, h, depth, color, _, _, woven = head or (0,) * 7
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if not planes or depth != 8 or woven:
        return None
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * planes)
    out = np.zeros((h, w * planes), np.uint8)
    above = np.zeros(w * planes, np.uint8)
    for r in range(h):
        kind, line = rows[r, 0], rows[r, 1:].copy()
        if kind == 2:
            line += above
        elif kind:
            line, up = line.tolist(), above.tolist()
            for k in range(len(line)):
                a, b, c = (line[k - planes] if k >= planes else 0), up[k], (up[k - planes] if k >= planes else 0)
                if kind == 1:
                    g = a
                elif kind == 3:
                    g = (a + b) // 2
                else:
                    p = a + b - c
                    g = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[k] = (line[k] + g) & 255
            line = np.array(line, np.uint8)
        out[r] = above = line
    if color == 3:
        return palette[out].astype(np.float32).mean(axis=2)
    grey = out.reshape(h, w, planes).astype(np.float32)
    return grey[..., : 1 if planes < 3 else 3].mean(axis=2)


def drawn(vectors: list[list[float] | None], side: int = 48) -> list[np.ndarray | None]:
    """Each vector as a square picture: its values, row by row, as a grid scaled up to ``side`` pixels, grey from least to greatest."""
    out: list[np.ndarray | None] = [None] * len(vectors)
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            by_size.setdefault(len(v), []).append(i)
    for n, at in by_size.items():
        edge = int(np.ceil(np.sqrt(n)))
        x = np.zeros((len(at), edge * edge), np.float32)
        x[:, :n] = np.nan_to_num(np.array([[0.0 if e is None else e for e in vectors[i]] for i in at], np.float32))
        low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
        x = (x - low) / np.maximum(high - low, 1e-12) * 255
        for i, image in zip(at, resized(x.reshape(-1, edge, edge), side, side), strict=True):
            out[i] = image
    return out


POINTS = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("n_points", T.IntegerType()), T.StructField("points", T.BinaryType()), T.StructField("bits", T.BinaryType())])


def _rows(images: list[np.ndarray | None]) -> tuple[list[int], list[int], list[bytes], list[bytes]]:
    # what is hashed is what is described: whole grey values
    images = [None if im is None else np.clip(np.rint(im), 0, 255).astype(np.uint8) for im in images]
    node = [0 if im is None else xxhash.xxh64_intdigest(im.tobytes(), im.shape[1]) - (1 << 63) for im in images]
    count, points, bits = [0] * len(images), [b""] * len(images), [b""] * len(images)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, im in enumerate(images):
        if im is not None:
            shapes.setdefault(im.shape, []).append(i)
    for at in shapes.values():
        for lo in range(0, len(at), 64):
            part = at[lo : lo + 64]
            got = describe(np.stack([images[i] for i in part]))
            order = np.argsort(got["image"], kind="stable")
            cuts = np.searchsorted(got["image"][order], np.arange(len(part) + 1))
            for k, i in enumerate(part):
                here = order[cuts[k] : cuts[k + 1]]
                count[i] = len(here)
                points[i] = np.stack([got[c][here] for c in ("y", "x", "scale", "angle")], 1).astype("<f4").tobytes()
                bits[i] = got["bits"][here].tobytes()
    return node, count, points, bits


def _unpacked(points: bytes, bits: bytes) -> dict[str, np.ndarray]:
    p = np.frombuffer(points, "<f4").reshape(-1, 4).astype(np.float64)
    return {"y": p[:, 0], "x": p[:, 1], "scale": p[:, 2], "angle": p[:, 3], "bits": np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)}


def _neighbours(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(corner, other): each corner with its nearest ones of the same level."""
    one, other = [np.empty(0, int)], [np.empty(0, int)]
    for scale in np.unique(p["scale"]):
        at = np.flatnonzero(p["scale"] == scale)
        here = p["x"][at] + 1j * p["y"][at]
        for lo in range(0, len(at), 256):  # so many rows of distances at a time
            away = np.abs(here[lo : lo + 256, None] - here[None, :])
            away[np.arange(len(away)), lo + np.arange(len(away))] = np.inf
            near = np.argsort(away, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(at) - 1)]
            one.append(np.repeat(at[lo : lo + 256], near.shape[1]))
            other.append(at[near.ravel()])
    return np.concatenate(one), np.concatenate(other)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each table and pair of neighbouring corners: sampled bits of both, and how they lie to each other.

    Directions are told from the first corner's own, so neither shift, scale
    nor turn of the image changes a row.
    """
    picks = [np.random.default_rng(100 + t).permutation(BITS)[: 2 * KEY_BITS].reshape(2, -1) for t in range(TABLES)]
    weight = (1 << np.arange(KEY_BITS)).astype(np.int64)
    for b in batches:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for node, points, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            p = _unpacked(points, bits)
            rows = np.unpackbits(p["bits"], axis=1)
            i, j = _neighbours(p)
            gap = (p["x"][j] - p["x"][i]) + 1j * (p["y"][j] - p["y"][i])
            byte = lambda angle: np.rint(angle * 128 / np.pi).astype(np.int64) & 255
            lie = byte(np.angle(gap) - p["angle"][i]) << 16 | byte(p["angle"][j] - p["angle"][i]) << 8 | np.clip(np.rint(16 * np.log2(np.abs(gap) / p["scale"][i] + 1e-9)), 0, 255).astype(np.int64)
            for t, (first, second) in enumerate(picks):
                key = (rows[:, first] @ weight)[i] << KEY_BITS | (rows[:, second] @ weight)[j]
                for to, x in zip(out, (np.full(len(i), t, np.int32), key, np.full(len(i), node), lie.astype(np.int32)), strict=True):
                    to.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["tab", "key", "node", "lie"])


def _alike(lie: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether two pairs of corners lie alike."""
    ok = np.abs((lie & 255) - (other & 255)) <= STRETCH_SLACK
    for shift in (8, 16):
        apart = ((lie >> shift) - (other >> shift)) & 255
        ok &= np.minimum(apart, 256 - apart) <= TURN_SLACK
    return ok


def _across(node: np.ndarray, sig: np.ndarray, start: np.ndarray, _: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket that lie alike and whose images are of different components; ``sig``: lie and component."""
    lie, root = sig[:, 0].byteswap().astype(np.int64), sig[:, 1]
    for lo, hi in zip(start[:-1], start[1:], strict=True):
        at = lo + np.argsort(root[lo:hi], kind="stable")
        after = np.searchsorted(root[at], root[at], side="right")
        found = [(k, at[after[n] :][_alike(lie[at[after[n] :]], lie[k])]) for n, k in enumerate(at) if after[n] < len(at)]
        if found:
            a, b = np.repeat(node[[k for k, _ in found]], [len(x) for _, x in found]), node[np.concatenate([x for _, x in found])]
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pair[0], pair[1]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True)
        ok = [are_copies(_unpacked(p, q), _unpacked(r, s)) for p, q, r, s in rows]
        kept = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        yield kept


def verified(scratch: Scratch, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct ``pairs(a, b)`` that are copies by all their corners."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("points").alias(f"p{c}"), F.col("bits").alias(f"q{c}"))
    full = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "pa", "qa", "pb", "qb")
    return scratch.keep(full.mapInArrow(_verified, "a long, b long"))


def star_links(scratch: Scratch, pairs: DataFrame, nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Links of which the components equal those of all copies among ``pairs(a, b)``.

    The copies of a group meet in many buckets, each with a least image of its
    own. So in each round an image is compared with the least one that it has
    not been compared with, and pairs that fall together go; what is apart after ``rounds`` is compared whole.
    """
    left = scratch.keep(pairs.distinct())
    found: DataFrame | None = None
    for step in range(rounds + 1):
        tried = left if step == rounds else scratch.keep(left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        new = verified(scratch, tried, nodes)
        found = new if found is None else found.union(new)
        if step < rounds:
            roots = components(scratch, found)
            side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
            named = left.join(tried, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
            left = scratch.keep(named.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
            if left.isEmpty():
                break
    return found


def copy_links(scratch: Scratch, nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` of which the components equal those of all copies that share a bucket.

    First the images of a bucket are compared with the bucket's least one, so
    a group of any number of copies falls together in about as many comparisons as
    it has images. Then every two images of a bucket that are still apart are
    compared; buckets of over ``chunk`` rows are dealt into pieces of which
    every two meet, so no task holds more than about two pieces.
    """
    keyed = nodes.select("node", "points", "bits").mapInArrow(_keys, "tab int, key long, node long, lie int")
    sizes = keyed.groupBy("tab", "key").agg(F.min(F.struct("node", "lie")).alias("least"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("least.node <> last")
    blocks = scratch.keep(keyed.join(sizes.drop("last"), ["tab", "key"]))
    turn = lambda k: F.pmod(F.shiftright("lie", k) - F.shiftright("least.lie", k), F.lit(256))
    alike = F.abs(F.col("lie").bitwiseAND(255) - F.col("least.lie").bitwiseAND(255)) <= STRETCH_SLACK
    for k in (8, 16):
        alike = alike & (F.least(turn(k), 256 - turn(k)) <= TURN_SLACK)
    star = star_links(scratch, blocks.where(alike & (F.col("node") != F.col("least.node"))).select(F.col("least.node").alias("a"), F.col("node").alias("b")), nodes)
    roots = components(scratch, star)
    named = blocks.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = named.groupBy("tab", "key").agg(F.min("root").alias("one"), F.max("root").alias("two")).where("one <> two").drop("one", "two")
    pieces = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("node"), pieces).cast("int")
    subs = F.when(pieces == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: F.least(own, j) * pieces + F.greatest(own, j)))
    binary = lambda c: F.to_binary(F.lpad(F.hex(c), 16, "0"), F.lit("hex"))
    met = named.join(apart, ["tab", "key"]).select("tab", "key", "node", F.concat(binary("lie"), binary("root")).alias("sig"), F.explode(subs).alias("sub"))
    return star.union(verified(scratch, links(met, 0, pairs=_across), nodes))


def image_copies(df: DataFrame, id_col: str, image: Column, draw: bool = False) -> DataFrame:
    """``(id, n_points int, component_id)`` of every row; component: least id reachable over links.

    ``image`` is a column of encoded images (``decoded``) or, with ``draw``, of
    number arrays that are drawn as pictures. Equal pixels are one node. Null,
    empty or unreadable images and pictures with fewer than ``CONSENSUS``
    corners have no links but to equal pixels; unreadable ones are alone.
    Repeated rows each get a row; an empty table gives an empty result; extra
    columns are ignored. Null ids name no component unless all its ids are null.
    Copies are found if a pair of neighbouring corners has the same key in one
    of the tables, which not all have: the tests measure the recall.
    """
    small_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "media")
    slim = df.select(F.col(f"`{id_col}`").alias("id"), image.alias("image"))
    kind = slim.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).to_pylist()
            images = drawn(values) if draw else [decoded(v) for v in values]
            node, count, points, bits = _rows(images)
            known = [None if im is None else x for im, x in zip(images, node, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(known, pa.int64()), pa.array(count, pa.int32()), pa.array(points, pa.binary()), pa.array(bits, pa.binary())], names=["id", "node", "n_points", "points", "bits"])

    rows = scratch.keep(slim.mapInArrow(run, T.StructType([T.StructField("id", kind), *POINTS.fields])))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.min(F.struct("points", "bits")).alias("p"))
    nodes = scratch.keep(nodes.select("node", "least_id", "p.points", "p.bits"))
    roots = components(scratch, copy_links(scratch, nodes.where(F.length("bits") >= CONSENSUS * BITS // 8)))
    per_node = named_components(scratch, nodes, roots).withColumnRenamed("component", "component_id")
    seen = rows.where("node is not null").select("id", "node", "n_points").join(per_node, "node").select("id", "n_points", "component_id")
    return seen.union(rows.where("node is null").select("id", "n_points", "id"))
