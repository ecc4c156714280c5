"""Networks against plain loops."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.operators import grid, networks as N


def plain_conv(x, weight, bias):
    o, i, a, b = weight.shape
    out = np.zeros((o, *x.shape[1:]))
    for k, r, c in np.ndindex(out.shape):
        out[k, r, c] = bias[k]
        for m, dr, dc in np.ndindex(i, a, b):
            y, z = r + dr - a // 2, c + dc - b // 2
            if 0 <= y < x.shape[1] and 0 <= z < x.shape[2]:
                out[k, r, c] += weight[k, m, dr, dc] * x[m, y, z]
    return out


def plain_up(x, weight, bias):
    out = np.zeros((weight.shape[1], 2 * x.shape[1], 2 * x.shape[2])) + bias[:, None, None]
    for m, r, c in np.ndindex(x.shape):
        for k, a, b in np.ndindex(weight.shape[1:]):
            out[k, 2 * r + a, 2 * c + b] += x[m, r, c] * weight[m, k, a, b]
    return out


def weights(kind, channels):
    rng, w = np.random.default_rng(5), {}

    def conv(name, i, o, k, up=False):
        w[f"{name}.weight"], w[f"{name}.bias"] = rng.normal(size=(i, o, 2, 2) if up else (o, i, k, k)) / 3, rng.normal(size=o)

    def norm(name, o):
        w.update({f"{name}.weight": rng.normal(size=o), f"{name}.bias": rng.normal(size=o), f"{name}.running_mean": rng.normal(size=o), f"{name}.running_var": rng.random(o) + 0.5})

    def block(name, i, o):
        if kind == "cnn":
            for part, a, k in ((".conv1.0", i, 3), (".conv2.0", o, 3), (".conv3", i, 1)):
                conv(name + part, a, o, k)
            norm(f"{name}.conv1.1", o), norm(f"{name}.BN_Relu.0", o)
        else:
            conv(f"{name}.resconv", i, o, 1)
            for k, a in ((1, i), (2, o), (3, o)):
                conv(f"{name}.double_conv{k}.0", a, o, 3), norm(f"{name}.double_conv{k}.1", o)
                w[f"{name}.conc_drop{k}.p_logit"] = np.array([-2.0])

    n = len(channels)
    if kind == "cnn":
        block("inc.conv", 1, channels[0])
        for k in range(1, n):
            block(f"down{k}.conv.1", channels[k - 1], channels[k])
        for k in range(1, n):
            top, low = channels[n - k], channels[n - k - 1]
            conv(f"up{k}.up", top, low, 2, True), block(f"up{k}.conv", 2 * low, low)
        conv("outc.conv.0", channels[0], 1, 1)
    else:
        for i in range(n):
            block(f"c{i}0", channels[i - 1] if i else 1, channels[i])
            for j in range(1, n - i):
                conv(f"up{i}{j}", channels[i + 1], channels[i], 2, True), block(f"c{i}{j}", channels[i] * (j + 1), channels[i])
        conv("conv_last_mean", channels[0], 1, 1)
        w["conv_last_drop1.p_logit"] = np.array([0.3])
    return w


def packed(w):
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def test_layers():
    rng = np.random.default_rng(1)
    for shape, k in (((2, 5, 4), 3), ((3, 1, 6), 1), ((1, 7, 7), 5)):
        x, weight, bias = rng.normal(size=shape), rng.normal(size=(4, shape[0], k, k)), rng.normal(size=4)
        assert np.allclose(N.convolved(x, weight, bias), plain_conv(x, weight, bias))
        weight = rng.normal(size=(shape[0], 3, 2, 2))
        assert np.allclose(N.widened(x, weight, bias[:3]), plain_up(x, weight, bias[:3]))
    x = rng.normal(size=(2, 5, 6))
    assert N.pooled(x).shape == (2, 2, 3) and N.pooled(x)[1, 1, 2] == x[1, 2:4, 4:6].max()
    assert N.centred(x, (8, 7)).shape == (2, 8, 7) and np.array_equal(N.centred(x, (8, 7))[:, 1:6, :6], x)


def test_the_whole_net_by_plain_loops(monkeypatch):
    image = np.random.default_rng(2).normal(size=(13, 10))
    made = {k: N.KINDS[k](weights(k, [2, 3, 4])) for k in N.KINDS}
    images = {"cnn": image, "bnn": image[:12, :8]}
    random = lambda: np.random.default_rng(9)
    fast = {k: made[k].sample(images[k], random()) for k in made}
    monkeypatch.setattr(N, "convolved", plain_conv)
    monkeypatch.setattr(N, "widened", plain_up)
    for k in made:
        assert fast[k].shape == images[k].shape and np.allclose(made[k].sample(images[k], random()), fast[k])
    # without dropout (p near 0) samples are all alike, with it they aren't
    still = {n: v - 40 if n.endswith("p_logit") else v for n, v in weights("bnn", [2, 3]).items()}
    a, b = (N.NestedUNet(still).sample(image[:4, :4], np.random.default_rng(s)) for s in (1, 2))
    assert np.allclose(a, b, atol=1e-4) and not np.allclose(*(made["bnn"].sample(images["bnn"], np.random.default_rng(s)) for s in (1, 2)))


def test_rows_samples_and_statistics(spark, tmp_path):
    rng = np.random.default_rng(4)
    given = {f"m{k}": rng.normal(size=(8, 12)) for k in range(3)}
    cells = spark.createDataFrame([(m, r, c, float(v)) for m, x in given.items() for (r, c), v in np.ndenumerate(x)], "matrix_id string, r int, c int, v double").repartition(3)
    for kind, samples in (("cnn", 1), ("bnn", 4)):
        content = packed(weights(kind, [2, 3, 4]))
        rows = N.inferred(N.matrices(cells), kind, content, samples, seed=1)
        found = {(r.matrix_id, r.sample, r.r, r.c): r.v for r in rows.collect()}
        again = {(r.matrix_id, r.sample, r.r, r.c): r.v for r in N.inferred(N.matrices(cells), kind, content, samples, seed=1, tasks=2).collect()}
        assert found == again and len(found) == 3 * samples * 96
        network = N.loaded(kind, content)
        if kind == "cnn":
            want = network.sample(given["m1"].T).T
            assert all(found["m1", 0, r, c] == pytest.approx(want[r, c]) for r in range(8) for c in range(12))
    stats = grid.sample_statistics(rows).where("matrix_id = 'm2' and r = 3 and c = 5").first()
    values = [found["m2", s, 3, 5] for s in range(4)]
    assert stats["mean"] == pytest.approx(np.mean(values)) and len(set(values)) == 4
    path = tmp_path / "w.npz"
    path.write_bytes(packed(weights("bnn", [2, 3, 4])))
    assert N.NumpyModel("bnn", str(path)).infer(given["m0"], 2).shape == (2, 8, 12)
