import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions.views import FACTORIES, Bounds, FixedArray, LeftToRight, RightToLeft, StaticBounds, Strided, Subbounds, View, convert_domain, convert_layout

shapes = st.lists(st.integers(1, 5), min_size=1, max_size=4).map(tuple)


@given(shapes, st.data())
@settings(deadline=None, max_examples=60)
def test_layouts_are_those_of_numpy(shape, data):
    point = tuple(data.draw(st.integers(0, n - 1)) for n in shape)
    assert RightToLeft(Bounds(*shape)).linearize(point) == np.ravel_multi_index(point, shape)
    assert LeftToRight(Bounds(*shape)).linearize(point) == np.ravel_multi_index(point, shape, order="F")
    for layout in (RightToLeft(Bounds(*shape)), LeftToRight(Bounds(*shape))):
        assert layout.required_span() == np.prod(shape)
    view = View.of(shape)
    axis = data.draw(st.integers(0, len(shape) - 1))
    dropped = view.drop_axis(axis, point[axis])
    assert dropped.data_at(point[:axis] + point[axis + 1 :]) == view.data_at(point)
    sizes = tuple(n - p for n, p in zip(shape, point))
    part = view.sub(point, sizes)
    assert part.data_at(point) == view.data_at(point) and part.in_bounds(point) and not part.in_bounds(tuple(p - 1 for p in point))
    assert [part.end(k) for k in range(len(shape))] == list(shape)


def test_small_things():
    assert FixedArray(1, 2) == FixedArray(1, 2) != FixedArray(1) and int(FixedArray(4)) == 4
    assert Bounds(2, 3).size(5) == 1 and StaticBounds(2).to_bounds() == Bounds(2) and Subbounds((1,), (2,)).offset(3) == 0
    assert Strided(Bounds(2, 0), (1, 1)).required_span() == 0 and View.of((2, 0)).is_empty()
    assert isinstance(RightToLeft(Bounds(2, 3)).remove_axis(0), RightToLeft) and Bounds(2, 3).remove_axis(0) == Bounds(3)
    assert View.of((2, 3)).size_in_bytes(8) == 48


@pytest.mark.parametrize("mapping", ["right_to_left", "left_to_right"])
def test_frames_of_views(spark, mapping):
    data = np.arange(24) * 10
    frame = spark.createDataFrame(list(enumerate(data.tolist())), "i bigint, v bigint")
    cube = data.reshape((2, 3, 4), order="C" if mapping == "right_to_left" else "F")
    view = View.of((2, 3, 4), frame, mapping)

    def read(v):
        rows = v.frame_of().orderBy("i").collect()
        assert [r["i"] for r in rows] == list(range(len(rows)))
        return np.array([r["v"] for r in rows]).reshape(v.sizes())

    assert (read(view) == cube).all() and (read(view.drop_axis(1, 2)) == cube[:, 2]).all()
    assert (read(view.sub((0, 1, 1), (2, 2, 2))) == cube[0:2, 1:3, 1:3]).all()
    assert view[1][2][3] == cube[1, 2, 3] == view(1, 2, 3) == view.drop_axis(0, 1).drop_axis(0, 2).drop_axis(0, 3).value()
    with pytest.raises(TypeError):
        view.access(1)


def test_factories_and_writing(spark):
    assert len(FACTORIES) == 16 and {"view", "view_mut", "strided_view", "cuda_strided_subview_mut"} <= set(FACTORIES)
    data = np.arange(12).reshape(3, 4)
    frame = spark.createDataFrame(list(enumerate(data.ravel().tolist())), "i bigint, v bigint")
    for name, make in FACTORIES.items():
        view = make(frame, (3, 4))
        assert view.writable == name.endswith("_mut") and (type(view.layout) is Strided) == ("strided" in name or "sub" in name)
        if not view.writable:
            with pytest.raises(TypeError):
                view.put(0)
    window = FACTORIES["view_mut"](frame, (3, 4)).sub((1, 1), (2, 2))
    want = data.copy()
    want[1:3, 1:3] = 7
    assert [r["v"] for r in window.put(7).orderBy("i").collect()] == want.ravel().tolist()
    with pytest.raises(TypeError):
        window.read_only().put(7)
    moved = FACTORIES["subview"](frame, (3, 4), offsets=(10, 20))
    assert moved.access(11, 22) == data[1, 2]


def test_conversions_keep_what_they_can():
    static, plain, part = StaticBounds(2, 3), Bounds(2, 3), Subbounds((1, 1), (2, 3))
    assert convert_domain(static, Bounds) == plain and convert_domain(plain, Subbounds) == Subbounds((0, 0), (2, 3)) and convert_domain(part, Subbounds) is part
    row = RightToLeft(static)
    assert convert_layout(row, Strided).strides == (3, 1) and type(convert_layout(row, RightToLeft, Bounds).domain) is Bounds
    for bad in (lambda: convert_domain(part, Bounds), lambda: convert_layout(row, LeftToRight), lambda: convert_layout(Strided(plain, (3, 1)), RightToLeft)):
        with pytest.raises(TypeError):
            bad()
