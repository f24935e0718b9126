"""What moves would gain, looked at together, is what each does by itself."""

import random
from collections import Counter

import pytest

from namesmith.operators import hierarchy


def leaves(n, seed):
    rng = random.Random(seed)
    some = lambda head, kinds, most: Counter({f"{head}{rng.randrange(kinds)}": rng.randint(1, 3) for _ in range(rng.randint(0, most))})
    made = {"firstNames": lambda: some("a", 2, 1), "coauthors": lambda: some("c", 9, 4), "institutions": lambda: some("i", 3, 1), "keywords": lambda: some("k", 3, 2), "emails": lambda: some("e", 40, 1)}
    # Some leaves are roots of an earlier round and count for several mentions.
    return [hierarchy.Node({k: made.get(k, Counter)() for k in hierarchy.BAGS}, [], f"m{i:03d}", rng.choice([1, 1, 1, 4])) for i in range(n)]


@pytest.mark.parametrize("seed, wide", [(1, 3), (2, 32), (3, 6)])
def test_gains_are_those_of_single_trials(monkeypatch, seed, wide):
    monkeypatch.setattr(hierarchy, "WIDE", wide)
    seen, together = Counter(), hierarchy.gains_of

    def checked(options, model, kinds):
        found = together(options, model, kinds)
        for (kind, a, b), gain in zip(options, found, strict=True):
            trial = hierarchy.Trial(model)
            trial.do((kind, a, b))
            assert abs(trial.gain() - gain) < 1e-9
            trial.undo()
            seen[kind, bool(b.parent)] += 1
        return found

    monkeypatch.setattr(hierarchy, "gains_of", checked)
    hierarchy.sample(leaves(70, seed), hierarchy.Model(size_weight=0.5), random.Random(seed))
    assert min(seen["left", True], seen["left", False], seen["up", False]) > 20 and any(k == "split" for k, _ in seen)


def test_a_node_leaves_its_tree_once_for_all_targets(monkeypatch):
    """Targets on one path don't make a trial each."""
    trials, targets, plain, together = [], [], hierarchy.Trial.touch, hierarchy.left_gains
    inside = []

    def left(moved, into, model, kinds):
        inside.append(1)
        out = together(moved, into, model, kinds)
        inside.pop()
        targets.append(len(into))
        return out

    monkeypatch.setattr(hierarchy.Trial, "touch", lambda self, *a: (trials.append(1) if inside else None, plain(self, *a))[1])
    monkeypatch.setattr(hierarchy, "left_gains", left)
    hierarchy.sample(leaves(150, 5), hierarchy.Model(size_weight=0.5), random.Random(5))
    assert max(targets) > 2 and len(trials) <= len(targets) < sum(targets)
