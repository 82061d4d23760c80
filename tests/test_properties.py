"""Properties that hold for any input, on cases hypothesis chooses."""

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from episodica.operators.survival import newton, tie_sums

days = st.lists(
    st.tuples(st.integers(1, 9), st.floats(0.05, 1), st.floats(0.05, 1), st.floats(0.5, 50), st.floats(0.5, 50)),
    min_size=1, max_size=20,
)


def arrays(rows):
    n, ev, eu, extra_v, extra_u = (np.array(c, float) for c in zip(*rows))
    return n, ev, eu, ev + extra_v, eu + extra_u


def newton_by_event(n, ev, eu, rv, ru, steps=50):
    """The same steps with one entry per tied event."""
    day = np.repeat(np.arange(len(n)), n.astype(int))
    gone = np.concatenate([np.arange(k) / k for k in n])
    weight, beta = ((ev + eu) / n)[day], 0.0
    for _ in range(steps):
        top = (rv[day] - gone * ev[day]) * np.exp(beta)
        share = top / (top + ru[day] - gone * eu[day])
        info = weight @ (share * (1 - share))
        step = np.clip((ev.sum() - weight @ share) / info, -2.0, 2.0)
        beta += step
        if abs(step) < 1e-10:
            break
    return beta, info**-0.5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.floats(0, 1e6)), min_size=1, max_size=20))
def test_tie_sums_equal_their_terms(rows):
    n, extra = (np.array(c, float) for c in zip(*rows))
    once, twice = tie_sums(n, n + extra)
    for i in range(len(n)):
        terms = 1 / (n[i] + extra[i] - np.arange(n[i]))
        assert np.isclose(once[i], terms.sum(), rtol=1e-11) and np.isclose(twice[i], (terms**2).sum(), rtol=1e-11)


@settings(max_examples=100, deadline=None)
@given(days, st.sampled_from([1, 7, 40]))
def test_newton_equals_one_entry_per_event(rows, times):
    n, ev, eu, rv, ru = arrays(rows)
    n = n * times
    beta, se, _ = newton(n, ev, eu, rv, ru)
    want, want_se = newton_by_event(n, ev, eu, rv, ru)
    assert np.isclose(beta, want, atol=1e-9) and np.isclose(se, want_se, rtol=1e-9)


def test_a_thousand_million_events_on_one_day():
    big = [np.array([x], float) for x in (1e9, 6e8, 4e8, 4e9, 6e9)]
    start = time.monotonic()
    beta, se, settled = newton(*big)
    assert time.monotonic() - start < 1 and settled
    small, small_se = newton_by_event(*[c / 1e4 for c in big])
    assert np.isclose(beta, small, atol=1e-4) and np.isclose(se * 100, small_se, rtol=1e-4)


@settings(max_examples=100, deadline=None)
@given(days)
def test_swapping_the_arms_turns_the_sign(rows):
    n, ev, eu, rv, ru = arrays(rows)
    beta, se, settled = newton(n, ev, eu, rv, ru)
    back, se_back, settled_back = newton(n, eu, ev, ru, rv)
    assert settled and settled_back
    assert np.isclose(beta, -back, atol=1e-7) and np.isclose(se, se_back, rtol=1e-6)


@settings(max_examples=100, deadline=None)
@given(days, st.floats(0.1, 10))
def test_scaling_all_weights_keeps_the_estimate(rows, factor):
    n, ev, eu, rv, ru = arrays(rows)
    beta, se, _ = newton(n, ev, eu, rv, ru)
    again, se_again, _ = newton(n, ev * factor, eu * factor, rv * factor, ru * factor)
    assert np.isclose(beta, again, atol=1e-7)
    assert np.isclose(se, se_again * np.sqrt(factor), rtol=1e-6)
