import numpy as np
import pytest

from gazeframe.operators import augment as A

T = 16


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(2)
    rows = [
        (k, rng.integers(0, 256, T * T).tolist(), (rng.integers(0, 2, T * T) * 255).tolist())
        for k in range(24)
    ]
    return spark.createDataFrame(rows, "image_id int, image array<int>, mask array<int>").cache()


def squares(df):
    return {
        r.image_id: (np.array(r.image).reshape(T, T), np.array(r.mask).reshape(T, T))
        for r in df.collect()
    }


def test_flips_move_both(pairs):
    before = squares(pairs)
    after = squares(A.augment_flip(pairs, T, A.Draws(1, "image_id"), chance=0.5))
    seen = set()
    for k, (image, mask) in before.items():
        options = {
            "none": lambda a: a, "h": np.fliplr, "v": np.flipud, "hv": lambda a: np.flipud(np.fliplr(a)),
        }
        match = [n for n, f in options.items() if (f(image) == after[k][0]).all() and (f(mask) == after[k][1]).all()]
        assert len(match) == 1
        seen.add(match[0])
    assert seen == {"none", "h", "v", "hv"}


def test_pad_crop_is_a_shift(pairs):
    before = squares(pairs)
    after = squares(A.augment_pad_crop(pairs, T, A.Draws(1, "image_id"), max_pad=3, chance=1.0))
    moved = 0
    for k, planes in before.items():
        hits = []
        for dx in range(-6, 7):
            for dy in range(-6, 7):
                shifted = []
                for plane in planes:
                    board = np.zeros((T + 12, T + 12), int)
                    board[6 : 6 + T, 6 : 6 + T] = plane
                    shifted.append(board[6 + dy : 6 + dy + T, 6 + dx : 6 + dx + T])
                if all((s == a).all() for s, a in zip(shifted, after[k])):
                    hits.append((dx, dy))
        assert len(hits) == 1
        moved += hits[0] != (0, 0)
    assert moved > 5


def test_neutral_parameters_change_nothing(pairs):
    draws = A.Draws(4, "image_id")
    before = squares(pairs)
    for after in (
        squares(A.augment_affine(pairs, T, draws, degrees=0.0, scales=(1.0, 1.0), chance=1.0)),
        squares(A.augment_zoom(pairs, T, draws, scales=(1.0, 1.0), chance=1.0)),
        squares(A.augment_photometric(pairs, T, draws, jitter=0.0, sigmas=(1e-3, 1e-3), chance=1.0)),
    ):
        assert all((before[k][j] == after[k][j]).all() for k in before for j in (0, 1))


def test_quarter_turn(pairs, monkeypatch):
    monkeypatch.setattr(A.Draws, "between", lambda self, name, low, high: __import__("pyspark").sql.functions.lit(90.0 if name == "angle" else 1.0 if name == "affine_scale" else 0.0))
    after = squares(A.augment_affine(pairs, T, A.Draws(1, "image_id"), chance=1.0))
    before = squares(pairs)
    for k, (image, mask) in before.items():
        assert (np.rot90(mask, -1) == after[k][1]).mean() > 0.95
        assert np.abs(np.rot90(image, -1)[1:-1, 1:-1] - after[k][0][1:-1, 1:-1]).max() <= 1


def test_same_seed_same_pairs(spark, pairs):
    raw = pairs.selectExpr(
        "image_id", "image image_pixels", "16 image_width", "16 image_height",
        "mask mask_pixels", "16 mask_width", "16 mask_height",
    )
    make = lambda seed, epoch: squares(A.training_pairs(raw, "image_id", seed, epoch, size=T))
    a, b, c = make(1, 0), make(1, 0), make(1, 1)
    assert all((a[k][0] == b[k][0]).all() for k in a)
    assert any((a[k][0] != c[k][0]).any() for k in a)
    assert all(0 <= a[k][0].min() and a[k][0].max() <= 1 and set(np.unique(a[k][1])) <= {0, 1} for k in a)
    plain = squares(A.training_pairs(raw, "image_id", augment=False, size=T))
    before = squares(pairs)
    assert all(np.allclose(plain[k][0], before[k][0] / 255) for k in before)
