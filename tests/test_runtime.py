import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.results import Completion, EmptyError, ErrorValue, Result, try_catch
from tessella.plans.events import BlockId, EventId, Scheduler
from tessella.operators.arrays import verify_all
from tessella.plans.runtime import ARGUMENTS, Batches, Cuda, CudaKernel, Frames, Host, Runtime, Submission, write
from tessella.sources.tables import read_array, write_array


def test_scheduler_orders_and_bounds():
    s, seen, running, most, lock = Scheduler(), [], [0], [0], threading.Lock()

    def work(k):
        def run():
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.02)
            with lock:
                running[0] -= 1
                seen.append(k)
        return run

    first = s.insert(work("a"), [])
    second = s.insert(work("b"), [first, first])
    many = [s.insert(work(k), []) for k in range(12)]
    assert not s.is_done(second) and not s.wait(second, time.monotonic())
    last = s.insert(None, [second, *many])
    assert s.wait(last) and seen.index("a") < seen.index("b") and most[0] <= 4
    assert s.is_done(EventId(10**9)) and s.active() == []
    s.shutdown()
    with pytest.raises(RuntimeError):
        s.insert(None, [])
    assert str(BlockId(EventId(3), 1)) == "3@1" and hash(BlockId(EventId(3), 1)) == 769


def test_arrays(spark):
    rt = Runtime(spark)
    a = rt.allocate(np.arange(6, dtype="float32").reshape(2, 3))
    assert (a.rank(), a.size(), a.size(1), a.size(7), a.is_empty(), a.sizes()) == (2, 6, 3, 1, False, (2, 3))
    assert a.read() == [0, 1, 2, 3, 4, 5] and a.read_numpy().dtype == np.float32
    b = a.reshape(3, 2)
    assert b.id() == a.id() and (b.flatten().read_numpy() == np.arange(6)).all()
    target = np.zeros((2, 3), "float32")
    a.read_into(target)
    assert target[1, 2] == 5 and len(a.read_bytes(24)) == 24 and a.read_header()["bytes"] == 24
    for bad, kind in ((lambda: a.reshape(4), RuntimeError), (lambda: a.read_bytes(1), ValueError), (lambda: a.read_into(np.zeros(6)), ValueError), (lambda: rt.declare(1 << 20, 1 << 20).size(), OverflowError), (lambda: rt.allocate([1], (2,)), ValueError)):
        with pytest.raises(kind):
            bad()
    assert rt.allocate([]).read() == [] and rt.allocate([2**64 - 1], dtype="uint64").read() == [2**64 - 1]
    rt.shutdown()


@pytest.mark.parametrize("eager", [False, True])
def test_tasks(spark, eager):
    with Runtime(spark, eager=eager) as rt:
        a, b, c, d = rt.allocate([1.0, 2.0, 3.0]), rt.allocate([4.0, 5.0, 6.0]), rt.declare(3), rt.declare(3)
        for launcher in (Host(), Cuda(1), CudaKernel(1, 256)):
            rt.wait(rt.submit(launcher, lambda x, y, k: x + y * k, a, b, 10, write(c)))
            assert c.read() == [41, 52, 63]
        rt.submit(Host(), lambda x: (x + 1, x - 1), c, write(c), write(d))  # c is read as it was, then is another block
        assert (c.read(), d.read()) == ([42, 53, 64], [40, 51, 62])
        rt.submit(Batches(), lambda x, k: x.clip(upper=k), c, 50, write(d))
        assert d.read() == [42, 50, 50]
        total = rt.declare(1)
        rt.submit(Frames(), lambda f: f.agg(F.sum("v").alias("v")).select(F.lit(0).cast("bigint").alias("i"), "v"), c, write(total))
        assert total.read() == [159]
        e = rt.submit(Host(), lambda x: x, a, write(d))
        assert rt.join(e) == e == rt.join([e, e])
        assert rt.wait_for(rt.join(e, rt.submit_barrier()), 20) and rt.is_done(e)
        with pytest.raises(RuntimeError):
            rt.submit(Host(), lambda x: x, rt.declare(3), write(d))
        assert rt.num_devices() == 1 and rt.device_info()["name"] == "CPU"


def test_poison(spark):
    with Runtime(spark, eager=True) as rt:
        a, b, c = rt.allocate([1, 2**31 - 1], dtype="int32"), rt.declare(2, dtype="int32"), rt.declare(2, dtype="int32")
        rt.submit(Host(), lambda x: x + F.lit(1).cast("int"), a, write(b))
        rt.wait(rt.submit(Host(), lambda x: x, b, write(c)))  # silent
        raised = []
        for x in (b, c):
            with pytest.raises(Exception, match="(?i)overflow") as e:
                x.read()
            raised.append(e.value)
        assert raised[0] is raised[1]
        rt.wait(rt.delete(b.block()))
        assert a.read() == [1, 2**31 - 1]


def test_blocks_go(spark, tmp_path):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    with Runtime(spark, eager=True) as rt:
        a, b = rt.allocate([1.0, 2.0]), rt.declare(2)
        rt.wait(rt.submit(Host(), lambda x: x * 2, a, write(b)))
        assert len(spark.sparkContext._jsc.getPersistentRDDs()) > before
        write_array(b, f"{tmp_path}/b")
        again = read_array(rt, f"{tmp_path}/b", "i", "v", (2,))
        assert again.read() == [2, 4]
        b.release()
        rt.synchronize()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_results():
    e = ValueError("foo")
    held = ErrorValue(e)
    assert held and held.what() == "foo" and held.holds(ValueError) and held.get_if(KeyError) is None and held == ErrorValue(e) != ErrorValue(ValueError("foo"))
    assert not ErrorValue() and held.map(lambda x: KeyError("bar")).type is KeyError
    with pytest.raises(EmptyError):
        ErrorValue().rethrow()
    good, bad = try_catch(lambda: 123), try_catch(lambda: 1 // 0)
    assert good.value() == 123 and good.map(lambda x: x + 1).value() == 124 and bad.map(str) is bad and bad.value_or(5) == 5 and Result().has_value
    for f, kind in ((bad.value, ZeroDivisionError), (good.get_error, EmptyError)):
        with pytest.raises(kind):
            f()
    got = []
    c = Completion(got.append)
    with pytest.raises(AssertionError):
        c.close()
    c.complete(good)
    with pytest.raises(AssertionError):
        c.complete(good)
    assert got == [good]


def test_long_chains_of_joins_end():
    s, gate = Scheduler(), threading.Event()
    last = s.insert(gate.wait, [])
    for _ in range(5000):
        last = s.insert(None, [last])
    fan = [s.insert(None, [last]) for _ in range(2000)]
    after = s.insert(lambda: None, fan)
    assert not s.is_done(last)
    gate.set()
    assert s.wait(after, time.monotonic() + 10) and s.active() == []
    s.shutdown()


def test_explicit_tasks_and_callbacks(spark):
    with Runtime(spark, eager=True) as rt:
        a = rt.allocate([1.0, 2.0])
        task, told = Submission(rt), []
        assert (task.add_input(a.block()), task.add_input(a.block()), task.add_output(), task.add_output()) == (0, 0, 0, 1)
        task.after_submission(told.append)
        task.after_submission(lambda e: told.append("second"))
        event = task.submit(lambda f: [f[a.block()], f[a.block()].select("i", (F.col("v") * 3).alias("v"))])
        assert told == [event, "second"]
        rt.wait(event)
        assert [r["v"] for r in rt.frame(BlockId(event, 1)).orderBy("i").collect()] == [3, 6]
        wrong = rt.submit_task(lambda f: [], [a.block()], 1)
        with pytest.raises(TypeError):
            rt.frame(BlockId(wrong))
        order = []
        first = rt.submit_task(lambda f: order.append(1) or [])
        rt.wait(rt.submit_task(lambda f: order.append(2) or [], after=[first]))
        assert order == [1, 2]


def test_rounds_bound_what_is_open(spark):
    with Runtime(spark) as rt:
        open_, most = [0], [0]

        def one(k):
            open_[0] += 1
            most[0] = max(most[0], open_[0])

            def work(_):
                time.sleep(0.01)
                open_[0] -= 1
                return []

            return rt.submit_task(work)

        events = rt.rounds(20, one, in_flight=5)
        assert len(events) == 20 and all(rt.is_done(e) for e in events) and most[0] <= 5


def test_arguments_of_other_types_and_deadlines(spark):
    class Boxed:
        def __init__(self, array):
            self.array = array

    ARGUMENTS[Boxed] = lambda b: b.array
    try:
        with Runtime(spark) as rt:
            a, b = rt.allocate([1.0, 2.0]), rt.declare(2)
            rt.submit(Host(), lambda x: x + 1, Boxed(a), write(b))
            assert b.read() == [2, 3]
            slow = rt.submit_task(lambda f: time.sleep(0.3) or [])
            assert not rt.wait_until(slow, time.monotonic() + 0.01) and rt.wait_until(slow, time.monotonic() + 5)
    finally:
        del ARGUMENTS[Boxed]


def test_verifying_nothing_succeeds(spark):
    with Runtime(spark) as rt:
        assert verify_all(rt.allocate([]), 1.0).first()["ok"] and not verify_all(rt.allocate([1.0, 2.0]), 1.0).first()["ok"]
