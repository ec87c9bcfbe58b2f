"""Content hashes of payloads of any size and shape, against json's canonical form."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions.text import content_hash


def canonical(payload):
    if payload is None:
        return None
    try:
        value = json.loads(payload, parse_constant=lambda name: 1 / 0)
        return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    except (ValueError, ZeroDivisionError, RecursionError):
        return None


def hashes(spark, payloads):
    frame = spark.createDataFrame(list(enumerate(payloads)), "i int, p string").repartition(4)
    return [r[0] for r in frame.select("i", content_hash(F.col("p")).alias("h")).orderBy("i").select("h").collect()]


def made(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 6)
    words = ["", "a", "Cà phê", "x y", "1e5", "NaN", "\U0001f600", "", "tab\t", "\\u00e9", "quote\"d", "back\\slash", "null", "z" * 40]
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -1, 7, 10**17, 10**18, -(10**18), 10**19, 2**63, 123456])
    if kind == 2:
        return rng.choice([0.5, 1.0, -0.0, 1e-7, 1e22, 12.25, 3.141592653589793])
    if kind < 6:
        return rng.choice(words)
    if kind == 6:
        return [made(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {rng.choice(words) + str(rng.randrange(3)): made(rng, depth + 1) for _ in range(rng.randrange(6))}


def test_random_payloads(spark):
    rng = random.Random(4)
    payloads = []
    for _ in range(600):
        text = json.dumps(made(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        payloads.append(text)
        at = rng.randrange(len(text) + 1)
        payloads.append(rng.choice([text[:at], text[:at] + rng.choice('"{}[],:.e+-09 \n\x01N\\') + text[at:], text + " ", "﻿" + text]))
    payloads += [None, "", " ", "{", '"', "NaN", "[Infinity]", "-0", "01", "1.", "1e5", "[1E5]", '{"a":1,"a":2}', "[" * 50 + "]" * 50, '{"\U0001f600":1,"￿":2}', "tru", "nulll", '"a"e']
    assert hashes(spark, payloads) == [canonical(p) for p in payloads]


@pytest.mark.parametrize("size", [3_000, 20_000, 1_000_000])
def test_long_payloads(spark, size):
    """Arrays and objects of up to a million characters, with and without what the built-in form can't take; nested ones too."""
    n = size // 8
    payloads = [
        json.dumps(list(range(n)), separators=(",", ":")),
        json.dumps({f"key{i}": i for i in range(n)}),
        json.dumps([{"a": "x", "b": [i]} for i in range(n // 4)]),
        json.dumps(["text"] * n) + "x",
        json.dumps([i / 8 for i in range(n)]),
        json.dumps({f"k{i}": 'quo"te' for i in range(n // 2)}),
        json.dumps("x" * size),
        '"' * size,
        "[" * 900 + ",".join(["1"] * n) + "]" * 900,
        " " * size + "7",
    ]
    assert hashes(spark, payloads) == [canonical(p) for p in payloads]
