import numpy as np
import pytest

from tabulant.plans import network, rounds
from tabulant.plans.network import Layer, Net, classifier_stack, dense_stack, named_views


def setup(layers, seed=0):
    """A float64 state, so that finite differences are sharp."""
    net = Net(layers)
    state = net.initial(np.random.default_rng(seed))
    theta, stats = state["theta"].astype(np.float64), state["stats"].astype(np.float64)
    theta += np.random.default_rng(1).normal(0, 0.1, theta.shape)
    return net, theta, stats


def numeric(f, theta, picks, eps=1e-6):
    out = []
    for i in picks:
        up, down = theta.copy(), theta.copy()
        up[i] += eps
        down[i] -= eps
        out.append((f(up) - f(down)) / (2 * eps))
    return np.array(out)


def test_contrastive_gradient():
    net, theta, stats = setup([*dense_stack("encoder", 5, 6, 3, 0.0), *dense_stack("projection", 6, 4, 2, 0.0)])
    x = np.random.default_rng(2).normal(size=(16, 5))

    def loss(flat):
        u, _ = net.forward(named_views(flat, net.shapes), named_views(stats.copy(), net.buffers), x, True, None, 2)
        return network.nt_xent(u, 0.5)[1].mean()

    grad = np.empty_like(theta)
    params = named_views(theta, net.shapes)
    u, cache = net.forward(params, named_views(stats.copy(), net.buffers), x, True, None, 2)
    value, du = network.nt_xent_gradient(u, 0.5)
    assert value == pytest.approx(loss(theta))
    net.backward(params, cache, du, named_views(grad, net.shapes))
    picks = np.random.default_rng(3).choice(len(theta), 60, replace=False)
    assert grad[picks] == pytest.approx(numeric(loss, theta, picks), abs=1e-7)


def test_supervised_gradient():
    layers = classifier_stack(5, 7, 3, 0.0)
    net, theta, stats = setup(layers)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(12, 5)), rng.integers(0, 3, 12)

    def loss(flat):
        z, _ = net.forward(named_views(flat, net.shapes), named_views(stats.copy(), net.buffers), x, True)
        return -np.log(network.softmax(z)[np.arange(12), y]).mean()

    grad = np.empty_like(theta)
    objective = network.Supervised(layers, 1e-4)
    params, buffers = named_views(theta, net.shapes), named_views(stats.copy(), net.buffers)
    assert objective.step(params, buffers, named_views(grad, net.shapes), x, y, rng) == pytest.approx(loss(theta))
    picks = np.random.default_rng(3).choice(len(theta), 40, replace=False)
    assert grad[picks] == pytest.approx(numeric(loss, theta, picks), abs=1e-7)


def test_running_statistics_follow_each_view():
    net = Net([Layer("norm", "n", 3, 3)])
    state = net.initial(np.random.default_rng(0))
    stats = named_views(state["stats"], net.buffers)
    x = np.random.default_rng(1).normal(size=(10, 3)).astype(np.float32)
    net.forward(named_views(state["theta"], net.shapes), stats, x, True, None, 2)
    mean, var = np.zeros(3), np.ones(3)
    for view in (x[:5], x[5:]):
        mean = 0.9 * mean + 0.1 * view.mean(axis=0)
        var = 0.9 * var + 0.1 * view.var(axis=0, ddof=1)
    assert stats["n.mean"] == pytest.approx(mean, abs=1e-6)
    assert stats["n.var"] == pytest.approx(var, abs=1e-6)


def test_adam_against_the_formula():
    rng = np.random.default_rng(0)
    theta = rng.normal(size=5)
    state = {"theta": theta.copy(), "m": np.zeros(5), "v": np.zeros(5), "t": 0, "scratch": np.empty(5)}
    m, v = np.zeros(5), np.zeros(5)
    for t in range(1, 6):
        g = rng.normal(size=5)
        network.adam(state, g.copy(), 0.01)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert state["theta"] == pytest.approx(theta, rel=1e-12)


def test_dropout_keeps_the_mean_and_is_off_in_evaluation():
    net = Net([Layer("dropout", rate=0.4)])
    x = np.ones((2000, 10), np.float32)
    rng = np.random.default_rng(0)
    out, _ = net.forward({}, {}, x.copy(), True, rng)
    assert out.mean() == pytest.approx(1.0, abs=0.03)
    assert (net.forward({}, {}, x.copy())[0] == x).all()


def test_parameter_counts():
    d = 12
    assert network.count(Net(dense_stack("e", d, 256, 4, 0.0)).shapes) == 256 * d + 199_168
    assert network.count(Net(dense_stack("p", 256, 256, 2, 0.0)).shapes) == 132_096
    assert network.count(Net(classifier_stack(256, 256, 5, 0.2)).shapes) == 66_304 + 257 * 5


@pytest.mark.parametrize(
    "rows, sizes", [(0, []), (1, []), (2, [2]), (8, [8]), (9, [9]), (10, [8, 2]), (16, [8, 8]), (17, [8, 9]), (25, [8, 8, 9])]
)
def test_batches_never_leave_a_single_row(rows, sizes):
    bounds = list(rounds.mini_batches(rows, 8))
    assert [b - a for a, b in bounds] == sizes
    assert [a for a, _ in bounds] == [0, *[b for _, b in bounds[:-1]]][: len(bounds)]
    assert not bounds or bounds[-1][1] == rows


def test_no_shard_takes_more_steps_than_allowed_between_two_averages():
    for n in (100, 32_767, 32_769, 150_000, 10**9, 10**12):
        rounds_needed = rounds.plan_rounds(n, 256, 4, 256)
        assert n / (rounds_needed * 4 * 256) <= 256 < n / ((rounds_needed - 1) * 4 * 256 or 1e-9)


def test_single_rows_join_another_shard():
    assert rounds.partners({(0, 0): 5, (0, 1): 1, (0, 2): 7}, 4) == {(0, 1): 2}
    assert rounds.partners({(0, 0): 1, (0, 3): 1}, 4) == {(0, 0): 3}
    assert rounds.partners({(0, 3): 1, (0, 1): 2, (1, 1): 1, (1, 2): 1, (1, 3): 1}, 4) == {(0, 3): 1, (1, 1): 2, (1, 3): 2}
    assert rounds.partners({(0, 2): 1}, 4) == {}


@pytest.mark.parametrize("rows", [[[1.0, 2.0], [3.0]], [[1.0, 2.0], None], [[1.0, None], [2.0, 3.0]]])
def test_ragged_and_null_arrays_are_refused(rows):
    import pyarrow as pa

    with pytest.raises(ValueError, match="one length"):
        network.rows_of(pa.array(rows, pa.list_(pa.float64())))


def test_blocks_of_equal_arrays():
    import pyarrow as pa

    assert network.rows_of(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert network.rows_of(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)
    assert network.rows_of(pa.array([[1.0], [2.0], [3.0]])[1:]).tolist() == [[2.0], [3.0]]
