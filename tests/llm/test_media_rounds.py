"""Comparisons of images that meet in many buckets."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import media
from millrace.llm.shared import Scratch, components


@pytest.mark.parametrize("step", [1, 2])
def test_a_group_of_copies_takes_about_a_comparison_an_image(spark, monkeypatch, step):
    pairs = spark.createDataFrame([(a, b) for b in range(40) for a in range(b)], "a long, b long")  # every image is the least of a bucket
    tried = []

    def verified(scratch, pairs, nodes):
        tried.append({(r.a, r.b) for r in pairs.collect()})
        return scratch.keep(pairs.where((F.col("b") - F.col("a")) % step == 0))

    monkeypatch.setattr(media, "verified", verified)
    scratch = Scratch(spark, "test")
    roots = {r.node: r.root for r in components(scratch, media.star_links(scratch, pairs, None)).collect()}
    assert len(set(roots.values())) == step and all(roots[n] == roots[n % step] for n in range(40))
    every = [p for t in tried for p in t]
    assert len(every) == len(set(every))
    if step == 1:
        assert len(every) < 80
    else:  # what is no copy is compared all the same
        assert {(a, b) for b in range(40) for a in range(b) if (b - a) % 2} <= set(every)
