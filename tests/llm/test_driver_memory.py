"""What a fit or a stage takes on the driver is bounded and given back."""

import numpy as np

from heddle.llm import common, toxicity


def test_grams_are_counted_in_parts(monkeypatch):
    texts = [bytes(np.random.default_rng(k).integers(97, 100, 60 + k, dtype=np.uint8)) for k in range(30)] + [b"", b"abc"]
    sets = [{t[i : i + 6] for i in range(len(t) - 5)} for t in texts]
    expected = {g: n for g in set().union(*sets) if (n := sum(g in s for s in sets)) >= toxicity.LEAST_TEXTS}
    made = []
    concatenate = np.concatenate
    monkeypatch.setattr(toxicity.np, "concatenate", lambda x: made.append(concatenate(x)) or made[-1])
    grams, n = toxicity._held_by(texts, 6)
    assert {int(g).to_bytes(6, "big"): int(k) for g, k in zip(grams, n)} == expected and (np.diff(grams) > 0).all()
    assert max(map(len, made)) < 0.5 * sum(map(len, sets))


def test_the_heap_is_given_back(spark):
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    kept = [bytes(1 << 20) for _ in range(40)]
    for part in kept:
        spark.sparkContext._jvm.java.util.Arrays.hashCode(part)  # garbage of the JVM
    before = runtime.totalMemory() - runtime.freeMemory()
    common.materialise(spark.range(10)).count()
    assert runtime.totalMemory() - runtime.freeMemory() < before
