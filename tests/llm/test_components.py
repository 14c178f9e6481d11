import random

import pytest

from lexloom.llm import components
from lexloom.llm._common import Scratch


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_components(spark, monkeypatch, small):
    """Chains, stars, cycles, loops and repeated links in either direction, by one task and by stars."""
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300), (-5, 41), (41, -5), (-5, 41)]
    links += [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(200)]
    label = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in label:
        before = dict(label)
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = [tuple(r) for r in components.components(frame, Scratch(spark, "cc")).collect()]
    assert len(got) == len(set(got)) and dict(got) == label
    assert components.components(frame.limit(0), Scratch(spark, "cc")).count() == 0
