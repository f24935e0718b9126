"""Hierarchical clustering of mentions by sampling moves on trees.

Rounds go from the finest canopy to the coarsest. Spark groups the current
roots by the round's canopy and deals groups to tasks; there pairs of nodes
propose merges and splits, and a move is accepted by the model score. Merged
roots go on with the sum of their bags, so a task never holds the mentions of a
block, only what is still apart.

A group of more than ``most`` roots meets by a schedule. Its roots are dealt to
q * q lots, the points of an affine plane of prime order q, and a sweep has a
meeting for each direction of lines: a task samples the q lots of one line.
Any two lots lie on one line, so in a sweep each two roots share a task (those
that merge go on as one). Sweeps, each with other lots, go on until one merges
nothing; each begins with a meeting of roots that share tokens. A group that fits
a task is the plane of one point. Random numbers follow from a block's name and
rows are sorted, so partitioning never changes a result.
"""

from __future__ import annotations

import math
import random
import uuid
import zlib
from collections import Counter
from collections.abc import Collection
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions.canopies import Canopy
from namesmith.functions.names import Processor, identity
from namesmith.operators.components import components
from namesmith.operators.features import mention_bags, title_vectors
from namesmith.plans.storage import cut, remove, shared_folder

#: From so many children on (more than two), those that don't move are scored as columns.
WIDE = 32
#: Parts of a meeting for each core, so that a core that is done takes another.
PARTS = 4
BAGS = ("firstNames", "middleNames", "emails", "institutions", "coauthors", "topics", "text", "keywords", "venues")


@dataclass(frozen=True)
class Bag:
    """Weights of a bag: cosine to the rest of the parent, its shift, entropy, size prior."""

    weight: float = 0.0
    shift: float = 0.0
    entropy: float = 0.0
    prior: float = 0.0


@dataclass(frozen=True)
class Name:
    """Weights of a name bag: differing initials, edit distance, overall weight, saturation, penalty without a name."""

    initial: float = 3.0
    name: float = 3.0
    weight: float = 1.0
    saturation: float = 16.0
    missing: float = 2.0
    limit: int = 5
    exceed: float = 100.0


@dataclass(frozen=True)
class Model:
    """Score terms; a term of weight zero isn't computed. The defaults are fixed values."""

    size_weight: float = 0.05
    size_exponent: float = 1.2
    names: dict[str, Name] = field(default_factory=lambda: {"firstNames": Name(), "middleNames": Name(saturation=26.0, missing=0.25)})
    bags: dict[str, Bag] = field(
        default_factory=lambda: {
            "emails": Bag(10), "institutions": Bag(10), "coauthors": Bag(4, -0.125, 0.125, 0.25), "topics": Bag(4, -0.125, 0.125, 0.25),
            "text": Bag(4, -0.125, 0.125, 0.25), "keywords": Bag(2, -0.125, 0.25, 0.25), "venues": Bag(4, -0.125, 0.125, 0.25),
        }
    )
    title: Bag = Bag(4, -0.25, 0.75)
    steps_per_node: int = 30
    most_steps: int = 300_000
    idle_steps: int = 50_000
    greedy: bool = False


class Node:
    """A node of a tree. ``leaf`` names a mention, or a root of an earlier round, whose inside is settled.

    ``over`` has the dot products with the parent's bags, ``fixed`` what of a node's
    score its own bags decide, ``hist`` how many tokens of a bag have each count.
    """

    def __init__(self, bags: dict[str, Counter], vec: list[float], leaf: str | None = None, count: int = 0) -> None:
        self.bags, self.vec, self.leaf, self.count = bags, vec, leaf, count
        self.squares = {k: sum(n * n for n in c.values()) for k, c in bags.items()}
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.score = 0.0
        self.over: dict[str, int] = {}
        self.fixed: tuple[float, list[tuple]] | None = None
        self.hist: dict[str, dict[int, int]] = {}
        self.wide: Wide | None = None

    def root(self) -> Node:
        node = self
        while node.parent:
            node = node.parent
        return node

    def add(self, other: Node, sign: int) -> None:
        self.count += sign * other.count
        self.fixed = None
        if self.vec:
            self.vec = [a + sign * b for a, b in zip(self.vec, other.vec, strict=True)]
        for k, bag in other.bags.items():
            if not bag:
                continue
            own, square, hist = self.bags[k], self.squares[k], self.hist.get(k)
            for token, n in bag.items():
                was = own.get(token, 0)
                now = was + sign * n
                square += now * now - was * was
                if now:
                    own[token] = now
                else:
                    del own[token]
                if hist is not None:
                    if was:
                        hist[was] -= 1
                        if not hist[was]:
                            del hist[was]
                    if now:
                        hist[now] = hist.get(now, 0) + 1
            self.squares[k] = square

    def leaves(self) -> list[Node]:
        return [x for x in self.nodes() if x.leaf]

    def nodes(self) -> list[Node]:
        return [self, *(x for c in self.children for x in c.nodes())]


@lru_cache(1 << 16)
def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def name_score(names: Collection[str], is_root: bool, w: Name) -> float:
    if len(names) > w.limit:
        return -w.weight * min(w.saturation, w.exceed)
    if len(names) < 2:
        return w.weight * (0.0 - (w.missing if not names and is_root else 0.0))
    found = sorted(names)
    pairs = [(a, b) for i, a in enumerate(found) for b in found[:i]]
    initials = sum(a[:1] != b[:1] for a, b in pairs)
    apart = sum(edits(a, b) for a, b in pairs if len(a) > 1 and len(b) > 1)
    score = -min(w.saturation, initials * w.initial) - min(w.saturation, apart * w.name)
    return w.weight * (score - (w.missing if not names and is_root else 0.0))


def cosine(a: dict, b: dict) -> float:
    over = sum(n * b.get(k, 0) for k, n in a.items())
    return over / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if over else 0.0


def to_rest(node: Node, k: str) -> float:
    """Cosine of a bag to the rest of the parent's, without making that rest."""
    own, above, square = node.bags[k], node.parent.bags[k], node.squares[k]
    over = sum(n * above[t] for t, n in own.items()) - square
    rest = node.parent.squares[k] - 2 * (over + square) + square
    return over / math.sqrt(square * rest) if over > 0 and rest > 0 else 0.0


def spread(weights: list[float]) -> float:
    """Entropy over its maximum."""
    total = sum(weights)
    return -sum(w / total * math.log(w / total) for w in weights if w) / math.log(len(weights)) if len(weights) > 1 and total else 0.0


def bag_dot(a: Counter, b: Counter) -> int:
    if len(a) > len(b):
        a, b = b, a
    get, out = b.get, 0
    for token, n in a.items():
        if m := get(token):
            out += n * m
    return out


def title_score(node: Node, model: Model) -> float:
    """The title term of a node under a parent."""
    own, rest = dict(enumerate(node.vec)), {i: p - c for i, (p, c) in enumerate(zip(node.parent.vec, node.vec, strict=True))}
    return model.title.weight * (cosine(own, rest) + model.title.shift) if any(node.vec) and any(rest.values()) else 0.0


def settled(node: Node, model: Model) -> tuple[float, list[tuple]]:
    """What of a node's score under a parent its own bags decide; remembered."""
    names = 0.0
    for k, w in model.names.items():
        names += name_score(node.bags[k], False, w)
    node.fixed = names, [(k, w.weight, w.shift, node.squares[k]) for k, w in model.bags.items() if w.weight and node.bags[k]]
    return node.fixed


def under(fixed: tuple[float, list[tuple]], above: dict[str, int], over: dict[str, int]) -> float:
    """Score without the title's term, from the squares of the parent's bags and the dot products with these."""
    score, parts = fixed
    for k, weight, shift, square in parts:
        whole = above[k]
        if whole > square:
            both = over[k]
            rest = whole - 2 * both + square
            score += weight * ((both - square) / math.sqrt(square * rest) + shift) if both > square and rest > 0 else weight * shift
    return score


def child_score(node: Node, model: Model, over: dict[str, int]) -> float:
    """``node_score`` of a node under a parent, from ``over`` (dot products with the parent's bags), whatever the size of the bags."""
    score = under(node.fixed or settled(node, model), node.parent.squares, over)
    if node.vec and model.title.weight:
        score += title_score(node, model)
    return score


def root_score(node: Node, model: Model) -> float:
    """``node_score`` of a root: entropies are of how many tokens have each count."""
    score = 0.0
    for k, w in model.names.items():
        score += name_score(node.bags[k], True, w)
        if not node.bags[k]:
            score -= w.missing
    for k, w in model.bags.items():
        bag = node.bags[k]
        if bag and (w.entropy or w.prior):
            hist = node.hist.get(k)
            if hist is None:
                hist = node.hist[k] = dict(Counter(bag.values()))
            total = sum(n * times for n, times in hist.items())
            entropy = -sum(times * (n / total * math.log(n / total)) for n, times in hist.items()) / math.log(len(bag)) if len(bag) > 1 else 0.0
            score -= w.entropy * entropy + w.prior * len(bag) / total
    if node.vec and model.title.weight:
        score -= model.title.entropy * spread([abs(x) for x in node.vec])
    return score + model.size_weight * node.count**model.size_exponent


def node_score(node: Node, model: Model) -> float:
    is_root, score = node.parent is None, 0.0
    for k, w in model.names.items():
        score += name_score(node.bags[k], is_root, w)
        if is_root and not node.bags[k]:
            score -= w.missing
    for k, w in model.bags.items():
        bag = node.bags[k]
        if not is_root and w.weight and bag:
            score += w.weight * (to_rest(node, k) + w.shift) if node.parent.squares[k] > node.squares[k] else 0.0
        elif is_root and bag:
            score -= w.entropy * spread(list(bag.values())) + w.prior * len(bag) / sum(bag.values())
    if node.vec and model.title.weight:
        if not is_root:
            score += title_score(node, model)
        else:
            score -= model.title.entropy * spread([abs(x) for x in node.vec])
    if is_root:
        score += model.size_weight * node.count**model.size_exponent
    return score


def tree_score(root: Node, model: Model) -> float:
    return sum(node_score(x, model) for x in root.nodes())


def moves(a: Node, b: Node) -> list[tuple[str, Node, Node]]:
    """What a pair of nodes proposes besides leaving all as it is."""
    if a.root() is not b.root():
        if a.parent is None and b.parent is None:
            return [("up", a, b)]
        out, node = [], a
        while node:
            big, small = (node, b) if node.count >= b.count else (b, node)
            if big.count > 1:
                out.append(("left", big, small))
            node = node.parent
        return out
    if a.leaf or b.leaf or a is b:
        return []
    return [("split", b, a) if a.count > b.count else ("split", a, b)]


class Wide:
    """The children of a node as columns: names' score, score, and for each weighted bag its square, the dot product with the node's and who has a token."""

    def __init__(self, node: Node, model: Model, kinds: list[str]) -> None:
        self.children = list(node.children)
        self.place = {id(c): i for i, c in enumerate(self.children)}
        for c in self.children:
            if c.fixed is None:
                child_score(c, model, c.over)
        self.names = np.array([c.fixed[0] for c in self.children])
        self.scores = np.array([c.score for c in self.children])
        self.squares, self.overs, self.holders = {}, {}, {}
        for k in kinds:
            square = np.array([c.squares[k] for c in self.children], float)
            if not square.any():
                continue
            self.squares[k], self.overs[k] = square, np.array([c.over[k] for c in self.children], float)
            held: dict[str, tuple[list, list]] = {}
            for i, c in enumerate(self.children):
                for token, n in c.bags[k].items():
                    places, counts = held.setdefault(token, ([], []))
                    places.append(i)
                    counts.append(n)
            self.holders[k] = held

    def after(self, above: dict[str, int], model: Model, moved: Node, sign: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Scores and dot products after a move, from the squares of the node's bags as they are then."""
        scores, overs = self.names.copy(), {}
        for k, square in self.squares.items():
            over, held, bag = self.overs[k], self.holders[k], moved.bags[k]
            if bag:
                over = over.copy()
                for token in bag if len(bag) < len(held) else held:
                    if (n := bag.get(token)) and token in held:
                        places, counts = held[token]
                        if len(places) < 8:
                            for i, m in zip(places, counts, strict=True):
                                over[i] += sign * n * m
                        else:
                            if isinstance(places, list):
                                places, counts = held[token] = np.array(places), np.array(counts, float)
                            over[places] += (sign * n) * counts
            overs[k], w, whole = over, model.bags[k], above[k]
            # Counts aren't negative: without anything in common, or without a rest, more is 0.
            more = over - square
            cosines = more / np.sqrt(np.maximum(square * (whole - over - more), 1.0))
            scores += (cosines + w.shift) * (w.weight * ((square > 0) & (whole > square)))
        return scores, overs


class Trial:
    """A move that is done, scored and undone.

    Only nodes whose bags, parent or parent's bags change are scored anew, and their
    dot products with the parent's bags (``overs``) change by those with what moved.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.kinds = [k for k, w in model.bags.items() if w.weight]
        self.log: list[tuple] = []
        self.touched: dict[int, Node] = {}
        self.overs: dict[int, dict[str, int]] = {}
        self.wide: list[tuple[Node, int | None, Node, int]] = []
        self.made: Node | None = None
        self.gone: list[Node] = []

    def touch(self, moved: Node, parent: Node, sign: int) -> None:
        """The nodes above a moved one, and their children; bags are still as before the move."""
        touched, overs = self.touched, self.overs
        parts = [(k, moved.bags[k]) for k in self.kinds if moved.bags[k]]
        below, node, last = moved, parent, {}
        while node:
            dots = {k: bag_dot(bag, node.bags[k]) for k, bag in parts}
            if below is not moved:  # both bags change
                over = dict(overs.get(id(below), below.over))
                for k, _ in parts:
                    over[k] += sign * (last[k] + dots[k]) + moved.squares[k]
                overs[id(below)] = over
            elif sign > 0:
                overs[id(moved)] = dict.fromkeys(self.kinds, 0) | {k: dots[k] + moved.squares[k] for k, _ in parts}
            wide = len(node.children) >= WIDE and not node.vec
            if wide:
                node.wide = node.wide or Wide(node, self.model, self.kinds)
                self.wide.append((node, node.wide.place.get(id(below)), moved, sign))
            for c in () if wide else node.children:
                if c is below:
                    continue
                key, made, bags = id(c), None, c.bags
                over = overs.get(key, c.over)
                for k, bag in parts:
                    if dots[k] and bags[k] and (d := bag_dot(bags[k], bag)):
                        if made is None:
                            made = dict(over)
                        made[k] += sign * d
                touched[key], overs[key] = c, over if made is None else made
            touched[id(node)] = node
            below, node, last = node, node.parent, dots
        touched[id(moved)] = moved

    def link(self, child: Node, parent: Node, at: int | None = None) -> None:
        parent.children.insert(len(parent.children) if at is None else at, child)
        child.parent, up = parent, parent
        while up:
            up.add(child, 1)
            up = up.parent
        self.log.append((self.unlink, child))

    def unlink(self, child: Node) -> None:
        parent = child.parent
        at, up = next(i for i, c in enumerate(parent.children) if c is child), parent
        while up:
            up.add(child, -1)
            up = up.parent
        del parent.children[at]
        child.parent = None
        self.log.append((self.link, child, parent, at))

    def lift(self, node: Node) -> None:
        """An inner node left with one child gives way to it; their bags are the same."""
        only, above = node.children[0], node.parent
        self.touched[id(only)] = only
        if above:
            self.overs[id(only)] = self.overs[id(node)]
        at = next((i for i, c in enumerate(above.children) if c is node), 0) if above else 0
        if above:
            above.children[at] = only
        only.parent, node.parent, node.children = above, None, []
        self.gone.append(node)
        self.log.append((self.lower, node, only, above, at))

    def lower(self, node: Node, only: Node, above: Node | None, at: int) -> None:
        node.children, only.parent, node.parent = [only], node, above
        if above:
            above.children[at] = node
        self.gone.remove(node)

    def do(self, move: tuple[str, Node, Node]) -> None:
        kind, a, b = move
        if kind == "up":
            self.made = Node({k: Counter() for k in a.bags}, [0.0] * len(a.vec))
            for x in (a, b):
                self.touch(x, self.made, 1)
                self.link(x, self.made)
            return
        moved = b if kind == "left" else a
        parent = moved.parent
        if parent:
            self.touch(moved, parent, -1)
            self.unlink(moved)
            if len(parent.children) == 1 and not parent.leaf:
                self.lift(parent)
        if kind == "left":
            self.touch(moved, a, 1)
            self.link(moved, a)

    def gain(self) -> float:
        """Score after the move less score before."""
        dead = {id(x) for x in self.gone}
        model, overs = self.model, self.overs
        self.new = {i: child_score(x, model, overs[i]) if x.parent else root_score(x, model) for i, x in self.touched.items() if i not in dead}
        out = sum(self.new.values()) - sum(x.score for x in self.touched.values())
        self.columns = []
        for node, at, moved, sign in self.wide:
            scores, rows = node.wide.after(node.squares, model, moved, sign)
            if at is not None:
                scores[at] = node.wide.scores[at]
            out += float(scores.sum() - node.wide.scores.sum())
            self.columns.append((node, at, scores, rows))
        return out

    def undo(self) -> None:
        log, self.log = self.log[::-1], []
        for step, *rest in log:
            step(*rest)

    def keep(self) -> None:
        for i, x in self.touched.items():
            x.score = self.new.get(i, 0.0)
            x.over = self.overs.get(i, x.over)
        for node, at, scores, rows in self.columns:
            for i, (c, score) in enumerate(zip(node.wide.children, scores.tolist(), strict=True)):
                if i != at:
                    c.score = score
                    c.over = c.over | {k: int(v[i]) for k, v in rows.items()}
            node.wide = None


def root_with(root: Node, moved: Node, model: Model) -> float:
    """``root_score`` of a root without a title vector as it is with the bags of another node."""
    score = 0.0
    for k, w in model.names.items():
        names = root.bags[k].keys() | moved.bags[k].keys()
        score += name_score(names, True, w)
        if not names:
            score -= w.missing
    for k, w in model.bags.items():
        bag, more = root.bags[k], moved.bags[k]
        if (bag or more) and (w.entropy or w.prior):
            if k not in root.hist:
                root.hist[k] = dict(Counter(bag.values()))
            hist, kinds, get = dict(root.hist[k]), len(bag), bag.get
            for token, n in more.items():
                if was := get(token, 0):
                    hist[was] -= 1
                else:
                    kinds += 1
                hist[was + n] = hist.get(was + n, 0) + 1
            total = sum(n * times for n, times in hist.items())
            entropy = -sum(times * (n / total * math.log(n / total)) for n, times in hist.items()) / math.log(kinds) if kinds > 1 else 0.0
            score -= w.entropy * entropy + w.prior * kinds / total
    return score + model.size_weight * (root.count + moved.count) ** model.size_exponent


def left_gains(moved: Node, into: list[Node], model: Model, kinds: list[str]) -> list[float]:
    """Gains of moving a node into each of some nodes of another tree, each the parent of the one before; no titles.

    What leaves the old tree is the same for all. Above a target, scores of those
    beside the path don't depend on which target below it is: each level is looked at once.
    """
    trial, gone, parent = Trial(model), -moved.score, moved.parent
    if parent:
        trial.touch(moved, parent, -1)
        trial.unlink(moved)
        if len(parent.children) == 1 and not parent.leaf:
            trial.lift(parent)
        del trial.touched[id(moved)]
        gone += trial.gain()
        trial.undo()
    fixed, bags, squares = moved.fixed or settled(moved, model), moved.bags, moved.squares
    parts = [(k, bags[k]) for k in kinds if bags[k]]
    chain = [into[0]]
    while chain[-1].parent:
        chain.append(chain[-1].parent)
    beside, as_target, on_path, below, last, low = [], [], [], None, {}, {}
    for node in chain:
        dots = {k: bag_dot(bag, node.bags[k]) for k, bag in parts}
        above = dict(node.squares)
        for k, d in dots.items():
            above[k] += 2 * d + squares[k]
        others = 0.0
        if len(node.children) >= WIDE:
            wide = node.wide = node.wide or Wide(node, model, kinds)
            scores, _ = wide.after(above, model, moved, 1)
            others = float(scores.sum() - wide.scores.sum())
            if below:
                at = wide.place[id(below)]
                others -= float(scores[at] - wide.scores[at])
        else:
            for c in node.children:
                if c is below:
                    continue
                over, held, made = c.over, c.bags, None
                for k, bag in parts:
                    if dots[k] and held[k] and (d := bag_dot(held[k], bag)):
                        if made is None:
                            made = dict(over)
                        made[k] += d
                others += under(c.fixed or settled(c, model), above, made or over) - c.score
        beside.append(others)
        own = under(fixed, above, dict.fromkeys(kinds, 0) | {k: d + squares[k] for k, d in dots.items()})
        if below:
            over = dict(below.over)
            for k, d in last.items():
                over[k] += d
            own += under(below.fixed or settled(below, model), above, over) - below.score
            for k, d in dots.items():
                over[k] += d + squares[k]
            names = sum(name_score(below.bags[k].keys() | bags[k].keys(), False, w) for k, w in model.names.items())
            grown = names, [(k, w.weight, w.shift, low[k]) for k, w in model.bags.items() if w.weight and (below.bags[k] or bags[k])]
            on_path.append(under(grown, above, over) - below.score)
        as_target.append(own)
        below, last, low = node, dots, above
    rest, out = gone + root_with(chain[-1], moved, model) - chain[-1].score, []
    for i in range(len(chain) - 1, -1, -1):
        rest += beside[i]
        out.append(rest + as_target[i])
        if i:
            rest += on_path[i - 1]
    return out[::-1][: len(into)]


def gains_of(options: list[tuple[str, Node, Node]], model: Model, kinds: list[str]) -> list[float]:
    """What each move would gain; those of one node into a path of another tree are looked at together."""
    out, at = [], 0
    while at < len(options):
        kind, a, b = options[at]
        end = at + 1
        if kind == "left" and not a.vec:
            while end < len(options) and options[end][2] is b and options[end][1] is options[end - 1][1].parent:
                end += 1
            out += left_gains(b, [x for _, x, _ in options[at:end]], model, kinds)
        else:
            trial = Trial(model)
            trial.do(options[at])
            out.append(trial.gain())
            trial.undo()
        at = end
    return out


def sample(roots: list[Node], model: Model, rng: random.Random) -> list[Node]:
    """Roots after sampling moves among the nodes of these trees."""
    nodes, idle, kinds = [x for r in roots for x in r.nodes()], 0, [k for k, w in model.bags.items() if w.weight]
    place = {id(x): i for i, x in enumerate(nodes)}
    for x in nodes:
        x.score = node_score(x, model)
        x.over = {k: bag_dot(x.bags[k], x.parent.bags[k]) for k, w in model.bags.items() if w.weight} if x.parent else {}
    for _ in range(min(len(nodes) * model.steps_per_node, model.most_steps)):
        if len(nodes) < 2 or idle >= model.idle_steps:
            break
        a, b = rng.sample(nodes, 2)
        options = moves(a, b)
        if not options:
            idle += 1
            continue
        idle, gains = 0, [0.0, *gains_of(options, model, kinds)]
        best = max(gains)
        if model.greedy:
            pick = gains.index(best)
        else:
            odds = [math.exp(g - best) for g in gains]
            pick = rng.choices(range(len(gains)), odds)[0]
        if pick:
            trial = Trial(model)
            trial.do(options[pick - 1])
            trial.gain()
            trial.keep()
            for g in trial.gone:  # the last node takes its place
                at, last = place.pop(id(g)), nodes.pop()
                if last is not g:
                    nodes[at], place[id(last)] = last, at
            if trial.made:
                place[id(trial.made)] = len(nodes)
                nodes.append(trial.made)
    return [x for x in nodes if x.parent is None]


ROOT = "node string, members array<string>, count long, canopies array<string>, vec array<double>, " + ", ".join(f"{k} map<string,double>" for k in BAGS)
COLUMNS = ["node", "count", "canopies", "vec", *BAGS]


def cluster_block(block: str, rows: pd.DataFrame, model: Model) -> pd.DataFrame:
    """The roots of one block after sampling; a root goes by its least mention, and by the canopies of that."""
    rng = random.Random(zlib.crc32(block.encode()))
    found = {r["node"]: r for r in rows.sort_values("node").to_dict("records")}
    leaves = [Node({k: Counter({t: int(n) for t, n in dict(r[k]).items()}) for k in BAGS}, [float(x) for x in r["vec"]], r["node"], int(r["count"])) for r in found.values()]
    out = []
    for root in sample(leaves, model, rng):
        members = sorted(x.leaf for x in root.leaves())
        out.append((members[0], members, root.count, list(found[members[0]]["canopies"]), root.vec, *({t: float(n) for t, n in root.bags[k].items()} for k in BAGS)))
    return pd.DataFrame(out, columns=["node", "members", "count", "canopies", "vec", *BAGS])


def prime(n: int) -> int:
    """The least prime of at least n."""
    while n < 2 or any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def plane(size: int, most: int) -> int:
    """The order of the plane on which so many roots meet: 1 if they fit a task, else lines of about nine tenths of ``most`` roots."""
    return 1 if size <= most else prime(math.ceil(size / (0.9 * most)))


def line(node: Column, order: Column, sweep: int, turn: int) -> Column:
    """The line of a direction (0 .. order) that a root's lot lies on, from 0; lots differ from sweep to sweep."""
    x, y = (F.pmod(F.xxhash64(node, F.lit(sweep), F.lit(axis)), order) for axis in "xy")
    return F.when(order == turn, x).otherwise(F.pmod(y + x * turn, order))


def grouped(roots: DataFrame, name: Column, most: int) -> DataFrame:
    """Roots with their group, its size n and the order of its plane."""
    orders = F.udf(lambda n: plane(n, most), "int")
    sizes = roots.groupBy(name.alias("group")).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("order", F.when(F.col("n") <= most, F.lit(1)).otherwise(orders("n")))
    return roots.select("*", name.alias("group")).join(sizes, "group")


def kin(roots: DataFrame, most: int, sweep: int) -> DataFrame:
    """roots with a line (below 0, so none of a plane's) by the least hash of their tokens, which brings together those that share many; ``most`` to a line."""
    tokens = F.flatten(F.array(*(F.map_keys(k) for k in BAGS if k not in ("firstNames", "middleNames"))))
    lot = F.pmod(F.coalesce(F.array_min(F.transform(tokens, lambda t: F.xxhash64(t, F.lit(sweep)))), F.xxhash64("node", F.lit(sweep))), F.col("order"))
    own = roots.withColumn("lot", lot)
    sizes = own.groupBy("group", "lot").agg(F.ceil(F.count("*") / most).alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(sweep)), F.col("parts"))
    return own.join(sizes, ["group", "lot"]).withColumn("line", -1 - F.col("lot") - F.col("order") * part).drop("lot", "parts")


def met(lined: DataFrame, model: Model, meeting: str) -> DataFrame:
    """The roots after the lines have met, with ``members`` (the roots that each was made of)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return cluster_block(f"{key[0]}#{key[1]}#{meeting}", part, model)

    # A stated number of parts isn't coalesced: roots are small rows, and by size alone few tasks would sample them all.
    spark = lined.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * spark.sparkContext.defaultParallelism)
    return cut(lined.repartition(parts, "group", "line").groupBy("group", "line").applyInPandas(run, ROOT), "met")


class Merges:
    """A written table of (old, new) roots that grows by a meeting at a time."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/merges-{uuid.uuid4().hex}", 0

    def add(self, found: DataFrame) -> int:
        """Appends a meeting's merges and returns how many there were."""
        n = found.select(F.coalesce(F.sum(F.size("members") - 1), F.lit(0))).first()[0]
        if n:
            found.select(F.explode("members").alias("old"), F.col("node").alias("new")).where("old <> new").write.mode("append").parquet(self.path)
        self.n += n
        return n

    def table(self) -> DataFrame:
        return self.spark.read.schema("old string, new string").parquet(self.path)


def gathered(roots: DataFrame, name: Column, model: Model, most: int, sweep: int, merges: Merges) -> DataFrame:
    """The roots of a round: every group has met, large ones until a whole sweep merged nothing.

    A sweep of a large group begins with a meeting of kin, as what is alike
    should meet first, and goes through all lines of its plane.
    """
    groups = cut(grouped(roots, name, most), "groups")
    quiet = groups.where("n = 1").select(*COLUMNS)
    while not groups.where("n > 1").isEmpty():
        whole = met(groups.where("n > 1 and order = 1").withColumn("line", F.lit(0)), model, str(sweep))
        merges.add(whole)
        quiet = quiet.unionByName(whole.select(*COLUMNS))
        large, changed = groups.where("order > 1").select(*COLUMNS, "group", "order"), 0
        orders = cut(large.select("group", "order").distinct(), "orders")
        last_turn = orders.agg(F.max("order")).first()[0]
        for turn in range(-1, last_turn + 1) if last_turn else ():
            active = large.where(F.col("order") >= turn)
            lined = kin(active, most, sweep) if turn < 0 else active.withColumn("line", line(F.col("node"), F.col("order"), sweep, turn))
            found = met(lined, model, f"{sweep}#{turn}")
            changed += merges.add(found)
            still = found.select(*COLUMNS).withColumn("group", name).join(orders, "group").select(large.columns)
            last, large = large, cut(still.unionByName(large.where(F.col("order") < turn)), "large")
            remove(last, found)
        sweep += 1
        if not changed:
            return quiet.unionByName(large.select(*COLUMNS))
        groups = cut(grouped(large.select(*COLUMNS), name, most), "groups")
        quiet = quiet.unionByName(groups.where("n = 1").select(*COLUMNS))
    return quiet


def resolve(mentions: DataFrame, canopies: list[Canopy], model: Model = Model(), processor: Processor = identity, keystore: DataFrame | None = None, dim: int = 0, most: int = 2000) -> DataFrame:
    """(mention_id, entity_id) by sampling in rounds over canopies, from fine to coarse.

    Names of mentions and coauthors are processed first. A task holds about
    ``most`` roots at most; larger groups meet by a schedule of tasks that brings
    each two of their roots together. Trees of earlier meetings are settled: they
    merge and move as wholes. An entity's id is its least mention.
    """
    named = mentions.dropDuplicates(["mentionId"]).withColumn("self", processor(F.col("self"))).withColumn("coauthors", F.transform("coauthors", lambda a: processor(a)))
    named = named.withColumn("canopies", F.array(*(c(F.col("self")) for c in canopies)))
    bags = mention_bags(named).drop("canopy", "lastNames").join(named.select("mentionId", "canopies"), "mentionId")
    vectors = title_vectors(named, keystore, dim) if keystore is not None else None
    rows = bags.join(vectors, "mentionId") if vectors is not None else bags.withColumn("vec", F.array().cast("array<double>"))
    roots = cut(rows.withColumnRenamed("mentionId", "node").withColumn("count", F.lit(1).cast("long")).select(*COLUMNS), "roots")
    ids, merges = roots.select(F.col("node").alias("mention_id")), Merges(mentions.sparkSession)
    for i in range(len(canopies)):
        name = F.get("canopies", F.lit(i))
        last, roots = roots, cut(gathered(roots, name, model, most, 1000 * i, merges), "roots")
        if i:
            remove(last)
    if not merges.n:
        return ids.withColumn("entity_id", F.col("mention_id"))
    parts = components(merges.table(), "old", "new")
    return ids.join(parts, F.col("mention_id") == F.col("node"), "left").select("mention_id", F.coalesce("component", "mention_id").alias("entity_id"))
