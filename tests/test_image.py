import numpy as np
import pytest

from rivulet.operators import image as I


@pytest.fixture
def rng():
    return np.random.default_rng(1)


@pytest.mark.parametrize("space", ["bt709", "bt601", "bt2020"])
def test_colour_round_trip(rng, space):
    rgb = rng.integers(0, 256, (3, 8, 10)).astype(np.uint8)
    back = I.yuv_to_rgb(*I.rgb_to_yuv(rgb, space), space)
    assert np.abs(back.astype(int) - rgb).max() <= 3 and np.abs(back.astype(int) - rgb).mean() < 1


def test_planes():
    data = np.arange(4 * 4 * 3 // 2, dtype=np.uint8).tobytes()
    y, u, v = I.planes(data, 4, 4, "YUV420P")
    assert y.shape == (4, 4) and u.tolist() == [[16, 17], [18, 19]] and v[0, 0] == 20
    y2, uv = I.planes(data, 4, 4, "NV12")
    assert uv.shape == (2, 2, 2)
    again = I.yuv420p_to_nv12(*I.nv12_to_yuv420p(y2, uv))
    assert (again[1] == uv).all() and I.planes(bytes(36), 4, 3, "RGB24")[0].shape == (3, 4, 3)


@pytest.mark.parametrize("mode", ["nearest", "bilinear", "bicubic"])
def test_resize(rng, mode):
    x = rng.integers(0, 256, (3, 12, 10)).astype(np.uint8)
    assert (I.resize(x, 10, 12, mode) == x).all()
    assert (I.resize(np.full((5, 7), 9, np.uint8), 15, 11, mode) == 9).all()
    assert I.resize(x, 5, 24, mode).shape == (3, 24, 5)


def test_bilinear_by_hand():
    assert I.resize(np.array([[0.0, 10.0]]), 4, 1).tolist() == [[0, 2.5, 7.5, 10]]


def test_moves(rng):
    x = rng.integers(0, 9, (2, 3, 4))
    assert (I.rotate(x, 90)[0] == np.rot90(x[0], -1)).all() and (I.rotate(I.rotate(x, 90), 270) == x).all()
    assert (I.mirror(I.mirror(x, "both"), "vertical") == I.mirror(x, "horizontal")).all()
    assert (I.crop(I.pad(x, 2, 1, 9, 8), 2, 1, 4, 3) == x).all()


def test_neighbourhoods(rng):
    x = rng.integers(0, 256, (9, 11)).astype(np.uint8)
    assert (I.filter2d(x, [[0, 0, 0], [0, 1, 0], [0, 0, 0]]) == x).all()
    assert I.erode(x)[4, 4] == x[3:6, 3:6].min() and I.dilate(x)[4, 4] == x[3:6, 3:6].max() and I.median_blur(x, 3)[4, 4] == np.median(x[3:6, 3:6])
    flat = np.full((6, 6), 50, np.uint8)
    for f in (lambda: I.gaussian_blur(flat, 3, 5), lambda: I.box_blur(flat, 3, 3), lambda: I.bilateral_filter(flat, 5, 10, 3)):
        assert (f() == 50).all()
    ramp = np.tile(np.arange(8.0), (6, 1))
    assert (I.sobel(ramp, 1, 0)[2:4, 2:6] == 8).all() and (I.sobel(ramp, 0, 1)[2:4, 2:6] == 0).all()


def test_canny_finds_the_edge_of_a_square():
    x = np.zeros((20, 20), np.uint8)
    x[6:14, 6:14] = 200
    e = I.canny(x, 100, 300)
    assert e[10, 5:7].any() and not e[10, 8:12].any() and not e[1].any()


def test_warp():
    x = np.arange(20.0).reshape(4, 5)
    shifted = I.warp_perspective(x, [[1, 0, 1], [0, 1, 0], [0, 0, 1]], 5, 4)
    assert np.allclose(shifted[:, 2:4], x[:, 1:3]) and (shifted[:, 0] == 0).all()
    assert np.allclose(I.warp_perspective(x, np.eye(3), 5, 4, "bilinear"), x)


def test_values(rng):
    x = rng.integers(0, 256, (3, 2, 2)).astype(np.uint8)
    assert np.allclose(I.normalize(x, [1, 2, 3], [2, 2, 2])[1], (x[1].astype(float) - 2) / 2)
    assert (I.overlay(x, 255 - x, 0.0) == x).all() and (I.gamma(x, 1.0) == x).all()
    assert I.saturate(np.array([-5, 2.5, 300]), "uint8").tolist() == [0, 3, 255]


def test_on_column(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), (None,)], "p array<double>")
    out = [r.p for r in I.on_column(df, "p", (2, 2), I.mirror, "horizontal").collect()]
    assert out == [[2, 1, 4, 3], None]
