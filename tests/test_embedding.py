"""Encoders of names: loaded once a worker, and the trained one against the hashed one on held-out variants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import similarity as sim
from terrane.functions.embedding import SvdModel, grams, load_model, model_embedder, save_model, svd_embedder, train_svd


def made(n, seed=3):
    """Names of a kind of place, a few rare words and a street, and a variant of each: the kind left out or in other words, letters
    missing or changed, marks gone."""
    rng = np.random.default_rng(seed)
    kinds = ["Nhà hàng", "Quán cà phê", "Công ty TNHH", "Cửa hàng tiện lợi", "Siêu thị", "Khách sạn", "Coffee", "Trung tâm thương mại"]
    streets = ["Nguyễn Huệ", "Lê Lợi", "Trần Phú", "Hai Bà Trưng", "Điện Biên Phủ", "Lý Thường Kiệt"]
    syllables = ["an", "binh", "hoa", "minh", "phu", "quy", "thanh", "long", "mai", "vien", "tra", "ngoc", "son", "ha", "kim", "sen", "dao", "lan", "truc", "bao"]
    plain = str.maketrans("àáảãạăâèéêìíòóôõơùúưỳýđÀÁĐêộợạảếềểễệữựừứửởờớỗổồốậấầẩẫắằẳẵặịỉĩụủũỵỷỹ", "aaaaaaaeeeiiooooouuuyydAADeooaaeeeeeuuuuuoooooooaaaaaaaaaaiiiuuuyyy")
    names, variants = [], []
    for _ in range(n):
        core = " ".join("".join(rng.choice(syllables, 2)).capitalize() for _ in range(2))
        kind, street = rng.choice(kinds), rng.choice(streets)
        names.append(f"{kind} {core} - {street}")
        twisted = list(core)
        at = rng.integers(1, len(twisted) - 1)
        if rng.random() < 0.5:
            del twisted[at]
        else:
            twisted[at] = "x"
        other = rng.choice([kind, rng.choice(kinds), ""])
        variants.append(f"{other} {''.join(twisted)} {rng.choice([street, ''])}".translate(plain).strip())
    return names, variants


def recall(a, b):
    a, b = np.stack(a).astype(float), np.stack(b).astype(float)
    return float((np.argmax(b @ a.T, axis=1) == np.arange(len(a))).mean())


@pytest.fixture(scope="module")
def model(spark):
    return train_svd(spark.createDataFrame([(x,) for x in made(4000, seed=11)[0]] + [(None,), (" ",)], "name string").repartition(5), "name", components=256, buckets=1024)


def test_trained_model_equals_a_fit_in_one_process(spark, model):
    names = made(4000, seed=11)[0]
    row, bucket, _ = grams(names, 1024)
    df = np.bincount(bucket, minlength=1024)
    assert np.allclose(model.weights, np.log((1 + len(names)) / (1 + df)) + 0.1)
    x = SvdModel(model.weights, np.zeros((1024, 0))).rows(names)
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(np.sort(np.linalg.norm(x @ model.components, axis=0))[::-1][:50], s[:50], rtol=1e-6)
    assert np.allclose(model.components.T @ model.components, np.eye(256), atol=1e-8)


def test_trained_neighbours_beat_hashed_ones_on_held_out_variants(spark, model):
    names, variants = made(600, seed=5)
    assert not set(names) & set(made(4000, seed=11)[0])
    both = spark.createDataFrame(list(zip(range(600), names, variants, strict=True)), "i int, a string, b string")
    hashed = both.select(sim.embed(F.col("a")), sim.embed(F.col("b"))).collect()
    encode = svd_embedder(model)
    trained = both.select(encode(F.col("a")), encode(F.col("b"))).collect()
    old, new = recall(*zip(*hashed, strict=True)), recall(*zip(*trained, strict=True))
    assert new > old + 0.02 and new > 0.8, (old, new)


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda names: np.array([[len(n), 1.0, 0.0] for n in names])

    names = spark.range(2000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("name "), F.col("id"))).alias("name")).repartition(16)
    got = names.select("name", model_embedder("counted", load)(F.col("name")).alias("v")).collect()
    assert all((list(r.v) == [0.0, 0.0, 0.0]) == (r.name is None) for r in got) and all(r.name is None or abs(np.linalg.norm(r.v) - 1) < 1e-6 for r in got)
    again = names.select(model_embedder("counted", load)(F.col("name")).alias("v")).collect()
    assert len(again) == 2000 and 1 <= loads.value <= 8


def test_a_saved_model_says_the_same_and_can_be_put_in_place(spark, model, tmp_path):
    save_model(spark, model, f"{tmp_path}/model")
    back = load_model(spark, f"{tmp_path}/model")
    assert np.array_equal(back.components, model.components) and np.allclose(back.encode(["Quán An"]), model.encode(["Quán An"]))
    before = sim._EMBEDDER
    try:
        sim.set_embedder(svd_embedder(back))
        row = spark.createDataFrame([("Quán An Bình", "Quan An Binh", "Siêu thị Z")], "a string, b string, c string").select(*[sim.embed(F.col(c)).alias(c) for c in "abc"]).select(sim.cosine(F.col("a"), F.col("b")).alias("near"), sim.cosine(F.col("a"), F.col("c")).alias("far")).first()
        assert row.near > row.far
    finally:
        sim.set_embedder(before)
