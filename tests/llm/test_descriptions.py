import numpy as np
import pytest

from lumora.llm import embeddings


def planted(d, mean, n, pairs, seed=1):
    """Vectors whose mean cosine is `mean`, and partners of the first ones at 0.90 to 0.92."""
    r = np.random.default_rng(seed)
    common = r.normal(size=d)
    x = np.sqrt(mean) * common / np.linalg.norm(common) + np.sqrt(1 - mean) * r.normal(size=(n, d)) / np.sqrt(d)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine, off = r.uniform(0.9, 0.92, size=(pairs, 1)), r.normal(size=(pairs, d))
    off -= (off * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    return x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off, axis=1, keepdims=True)


@pytest.mark.parametrize("d", [64, 384, 768])
@pytest.mark.parametrize("mean", [0.0, 0.2, 0.4, 0.6, 0.8])
def test_recall_of_descriptions(d, mean):
    """More vectors than the sample, of which half of the pairs are none."""
    x, y = planted(d, mean, 6000, 400)
    sample = x[np.random.default_rng(2).permutation(len(x))[:2048]]
    own = embeddings.describe(sample, 0.9, len(x))
    a, b = own.near(x[:400]), own.near(y)
    met = (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)
    assert (met & ((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)) >= own.shared)).mean() >= 0.95
    assert own.share < (0.3 if mean < 0.7 else 0.9)


def test_recall_of_a_table_with_a_common_direction(spark, tmp_path):
    x, y = planted(64, 0.4, 4000, 300)
    rows = np.concatenate([x, y]).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "v"))
    unit = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.read.parquet(str(tmp_path / "v")), threshold=0.9, sample=1024, part=512).collect()}
    assert all(found[i] <= links[i] for i in found) and sum(found.values()) >= 0.95 * links.sum()
    assert len(found) == len(rows)
