"""The most similar title of a list for each name, without comparing every two of them.

The similarity is 2M / (|a| + |b|), where M counts the characters of the matching blocks of two keys. Two facts bound it:

* Between two blocks that follow one another at least one key has a gap, so there are at most |a| + |b| - 2M + 1 blocks, and the
  keys share at least M less as many bigrams: 3M - |a| - |b| - 1. A name of six characters or more thus finds every title that
  is as similar as `NEAR` by its rarest bigrams (a prefix filter) among titles of fitting length. If many titles have these, as
  those of two digits where titles end in numbers, the grid is cheaper: such names go there.
* The blocks are a common subsequence, so M is at most the longest one, which bit operations find. Names without a near title
  meet the titles in a grid of parts. There the titles stand in a trie: a prefix's common subsequence, the characters of the name
  that the signs left below it can still meet, and the lengths of the titles below it bound them all, so names go down only where
  the best so far can be reached; pairs at the ends are compared.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.text import normal_title
from tallybrook.sources.shared import discard, materialise

#: Similarity from which bigrams find every title; shortest name for which they must share one.
NEAR, SHORTEST = 0.85, 6
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"  # all that normal_title() leaves
_CODE = np.full(128, len(_SIGNS), np.uint8)
_CODE[[ord(c) for c in _SIGNS]] = np.arange(len(_SIGNS))
_BITS, _LONG = 63, 256  # names and titles beyond these are bounded by the characters they share, in any order
#: Names that go down the trie at a time, nodes that give a name its floor, and pairs of name and node that are held at once.
_LOT, _BEAM, _WIDE = 512, 6, 1 << 18
#: A cell of the grid has so many times `block` names at most, and so many characters of titles for each of `block`.
_MORE, _CHARS = 64, 6400
#: Titles that one task takes of one bigram; bigrams there are, and their repeats in a key that are told apart by how many titles have them.
_SPLIT, _PAIRS, _REPEATS = 4096, len(_SIGNS) ** 2, 64
#: Titles that a name meets by its bigrams: so many at most, or one of so many of all; else it meets them in the grid.
_FEW, _SHARE = 16, 4096
#: SequenceMatcher leaves out frequent signs of keys from this length on.
_JUNK = 200


def _key(title: Column) -> Column:
    return normal_title(F.coalesce(title, F.lit("")))


# ---- near titles by bigrams

def _needed(n: np.ndarray) -> np.ndarray:
    """Bigrams that a key of n characters shares at least with any key that is as similar as NEAR."""
    both = n + np.ceil(n * (NEAR / (2 - NEAR)) - 1e-9)  # characters of both, the other as short as it may be
    return np.ceil(both * (1.5 * NEAR - 1) - 1 - 1e-9).astype(np.int64)


def _bigrams(keys: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, bigram, number): each bigram with its number among the equal ones of the key, so that shared ones count repeats."""
    own = np.repeat(np.arange(len(keys)), keys.str.len().to_numpy(np.int64))
    code = _CODE[np.frombuffer("".join(keys).encode("ascii"), np.uint8)].astype(np.int64)
    inside = own[1:] == own[:-1]
    held = np.sort((own[1:] * _PAIRS + code[:-1] * len(_SIGNS) + code[1:])[inside])
    starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]][: len(held)])
    number = np.arange(len(held)) - np.repeat(starts, np.diff(np.r_[starts, len(held)])) + 1
    return held // _PAIRS, held % _PAIRS, number


def _held(titles: DataFrame) -> np.ndarray:
    """How many titles have each bigram n times or more, n up to _REPEATS."""

    def of_batches(frames):
        for frame in frames:
            _, gram, number = _bigrams(frame["title_key"])
            gram, many = np.unique((gram * _REPEATS + number - 1)[number <= _REPEATS], return_counts=True)
            yield pd.DataFrame({"gram": gram, "held": many})

    out = np.zeros(_PAIRS * _REPEATS, np.int64)
    for row in titles.select("title_key").mapInPandas(of_batches, "gram long, held long").groupBy("gram").agg(F.sum("held").alias("held")).collect():
        out[row.gram] = row.held
    return out.reshape(_PAIRS, _REPEATS)


def _prefixes(keys: DataFrame, key: str, held: np.ndarray, most: int | None = None) -> DataFrame:
    """key, gram, held: the rarest bigrams of each key (held: titles that have it), of which it shares one with any near key; bigrams
    that no title has would come first, and join none. most: keys whose bigrams are held more often, all in all, have no row."""

    def of_batches(frames):
        for frame in frames:
            own, gram, number = _bigrams(frame[key])
            many = held[gram, np.minimum(number, _REPEATS) - 1]
            order = np.lexsort((number, gram, many, own))
            order = order[many[order] > 0]
            own, gram, number, many = own[order], gram[order], number[order], many[order]
            size = np.bincount(own, minlength=len(frame))
            rank = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            take = rank <= (size - np.maximum(_needed(frame[key].str.len().to_numpy(np.int64)), 1))[own]
            if most is not None:
                take &= (np.bincount(own[take], many[take], len(frame)) <= most)[own]
            yield pd.DataFrame({key: frame[key].to_numpy()[own[take]], "gram": (number * _PAIRS + gram)[take], "held": many[take]})

    return keys.select(key).mapInPandas(of_batches, f"{key} string, gram long, held long")


def near_pairs(names: DataFrame, titles: DataFrame, most: int | None = None) -> DataFrame:
    """name_key, title_key: every two as similar as NEAR, and some that are less, of distinct keys; names have SHORTEST characters
    or more. most: names that would meet more titles, repeats included, are left out."""
    held = _held(titles)
    parts = F.ceil(F.col("held") / _SPLIT).cast("int")
    left = _prefixes(names, "name_key", held, most).select("name_key", "gram", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = _prefixes(titles, "title_key", held).select("title_key", "gram", F.pmod(F.xxhash64("title_key"), parts).cast("int").alias("part"))
    shorter, longer = F.least(F.length("name_key"), F.length("title_key")), F.greatest(F.length("name_key"), F.length("title_key"))
    fits = 2 * shorter >= NEAR * (shorter + longer) - 1e-9
    return left.join(right, ["gram", "part"]).where(fits).select("name_key", "title_key").distinct()


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SequenceMatcher's ratio of every two; those of usual lengths are compared by vectors."""
    usual = (a.str.len().between(1, _BITS) & (b.str.len() < _JUNK)).to_numpy(bool)
    out = np.empty(len(a))
    (own, names), (title, keys) = pd.factorize(a[usual]), pd.factorize(b[usual])
    if len(own):
        out[usual] = TitleBlock(list(keys), [0] * len(keys))._ratios(list(names), _masks(list(names))[0], own, title)
    out[~usual] = [SequenceMatcher(None, x, y).ratio() for x, y in zip(a[~usual], b[~usual], strict=True)]
    return pd.Series(out)


# ---- the others in a grid

class TitleBlock:
    """Keys of titles (distinct) with their places (ord), and bounds of their similarity to a name."""

    def __init__(self, keys: list[str], ords: list[int]):
        self.keys, self.ords = keys, np.array(ords, np.int64)
        self.length = np.array([len(x) for x in keys], np.int64)
        self.short = np.flatnonzero(self.length <= _LONG)

    @cached_property
    def counts(self) -> np.ndarray:
        """How often each key has each sign."""
        codes = [_CODE[np.frombuffer(x.encode("ascii"), np.uint8)] for x in self.keys]
        return np.array([np.bincount(c, minlength=len(_SIGNS)) for c in codes], np.int64).reshape(len(codes), len(_SIGNS))

    @cached_property
    def signs(self) -> np.ndarray:
        """A row for each of the `short` keys, filled up with a sign of none."""
        out = np.full((len(self.short), int(self.length[self.short].max(initial=0))), len(_SIGNS), np.uint8)
        held = _CODE[np.frombuffer("".join([self.keys[i] for i in self.short.tolist()]).encode("ascii"), np.uint8)]
        out[np.arange(out.shape[1]) < self.length[self.short, None]] = held
        return out

    @cached_property
    def trie(self) -> Trie:
        return Trie([self.keys[i] for i in self.short.tolist()], self.signs, self.ords[self.short])

    def bounds(self, name: str) -> np.ndarray:
        code = _CODE[np.frombuffer(name.encode("ascii"), np.uint8)]
        most = np.minimum(np.bincount(code, minlength=len(_SIGNS)), self.counts).sum(1)
        if 0 < len(name) <= _BITS:
            at, _, full = _masks([name])
            open_ = np.full(len(self.short), full[0], np.uint64)  # a bit that is gone is a character of the common subsequence
            for signs in self.signs.T:
                met = open_ & at[0][signs]
                open_ = ((open_ + met) | (open_ - met)) & full[0]
            most[self.short] = len(name) - np.bitwise_count(open_).astype(np.int64)
        both = len(name) + self.length
        return np.where(both > 0, 2.0 * most / np.maximum(both, 1), 1.0)

    def best(self, name: str) -> tuple[float, int, int]:
        """Similarity, index of the title, and how many were compared; of equal ones the first by ord."""
        bound = self.bounds(name)
        top, at, compared = -1.0, -1, 0
        for j in np.lexsort((self.ords, -bound)).tolist():
            if bound[j] < top or (bound[j] == top and self.ords[j] > self.ords[at]):
                break
            compared += 1
            ratio = SequenceMatcher(None, name, self.keys[j]).ratio()
            if ratio > top or (ratio == top and self.ords[j] < self.ords[at]):
                top, at = ratio, j
        return top, at, compared

    def best_of_all(self, names: list[str]) -> list[tuple[float, int, int]]:
        """best() of every name; names and titles of usual lengths meet in the trie, many names at a time."""
        if 0 < len(self.short) < len(self.keys):
            return self._of_parts(names, [self.short, np.flatnonzero(self.length > _LONG)])
        usual = np.array([0 < len(x) <= _BITS for x in names], bool) & (len(self.short) > 0)
        out: list = [None if u else self.best(x) for x, u in zip(names, usual.tolist(), strict=True)]
        places = np.flatnonzero(usual)
        for at in range(0, len(places), _LOT):
            few = places[at : at + _LOT].tolist()
            for k, found in zip(few, self._descended([names[k] for k in few]), strict=True):
                out[k] = found
        return out

    def _of_parts(self, names: list[str], parts: list[np.ndarray]) -> list[tuple[float, int, int]]:
        found = []
        for part in parts:
            own = TitleBlock([self.keys[i] for i in part.tolist()], self.ords[part].tolist()).best_of_all(names)
            found.append([(ratio, int(part[i]), n) for ratio, i, n in own])
        return [(*max((x[:2] for x in of), key=lambda x: (x[0], -self.ords[x[1]])), sum(x[2] for x in of)) for of in zip(*found, strict=True)]

    def _descended(self, names: list[str]):
        masks = _masks(names)
        top, at = np.full(len(names), -1.0), np.full(len(names), -1, np.int64)  # `at` is an index, and -1 has no place
        place = np.r_[self.ords, np.iinfo(np.int64).max]
        compared = np.zeros(len(names), np.int64)
        for beam in (_BEAM, None):  # a few titles that promise most give a floor, which the others must reach
            own, title, bound = self.trie.titles(*masks, top, place[at], beam)
            order = np.lexsort((self.ords[title], -bound, own))
            own, title, bound = own[order], title[order], bound[order]
            take = 2
            while len(own):
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
                now = rank < take
                ratio = self._ratios(names, masks[0], own[now], title[now])
                compared += np.bincount(own[now], minlength=len(names))
                self._better(top, at, place, own[now], title[now], ratio)
                left = ~now & ((bound > top[own]) | ((bound == top[own]) & (self.ords[title] < place[at[own]])))
                own, title, bound = own[left], title[left], bound[left]
                take *= 2
        return zip(top.tolist(), at.tolist(), compared.tolist(), strict=True)

    def _better(self, top, at, place, own, title, ratio) -> None:
        order = np.lexsort((self.ords[title], -ratio, own))
        first = order[np.r_[True, own[order][1:] != own[order][:-1]]]
        own, title, ratio = own[first], title[first], ratio[first]
        more = (ratio > top[own]) | ((ratio == top[own]) & (self.ords[title] < place[at[own]]))
        top[own[more]], at[own[more]] = ratio[more], title[more]

    def _ratios(self, names: list[str], at: np.ndarray, own: np.ndarray, title: np.ndarray) -> np.ndarray:
        """SequenceMatcher's ratio of every two; keys of _JUNK characters or more are its own."""
        out = np.empty(len(own))
        junk = self.length[title] >= _JUNK
        for k in np.flatnonzero(junk).tolist():
            out[k] = SequenceMatcher(None, names[own[k]], self.keys[title[k]]).ratio()
        rest = np.flatnonzero(~junk)
        size = np.array([len(x) for x in names], np.int64)
        for i in range(0, len(rest), 8192):
            k = rest[i : i + 8192]
            length = self.length[title[k]]
            equal = at[own[k, None], self.signs[title[k], : int(length.max(initial=0))]]
            out[k] = 2.0 * _matching(equal, size[own[k]], length) / (size[own[k]] + length)
        return out


def _masks(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of names of 1 to _BITS signs: a word of the places of each sign, lengths, and words of all places."""
    length = np.array([len(x) for x in names], np.int64)
    code = _CODE[np.frombuffer("".join(names).encode("ascii"), np.uint8)]
    at = np.zeros((len(names), len(_SIGNS) + 1), np.uint64)
    own = np.repeat(np.arange(len(names)), length)
    place = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    np.bitwise_or.at(at, (own, code), np.uint64(1) << place.astype(np.uint64))
    return at, length, (np.uint64(1) << length.astype(np.uint64)) - np.uint64(1)


def _matching(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters in the matching blocks of each two keys of a and b characters: the longest one, of equals the first in the
    first key and then in the second, and the same again to its left and right. equal: a word of the places of the first key
    for each character of the second."""
    total, one = np.zeros(len(equal), np.int64), np.uint64(1)
    own, a0, a1, b0, b1 = np.arange(len(equal)), np.zeros_like(a), a, np.zeros_like(b), b
    column = np.arange(equal.shape[1])
    while len(own):
        inside = ((one << a1.astype(np.uint64)) - one) & ~((one << a0.astype(np.uint64)) - one)
        here = np.where((column >= b0[:, None]) & (column < b1[:, None]), equal[own] & inside[:, None], np.uint64(0))
        i, j, size = np.zeros_like(a0), np.zeros_like(b0), np.zeros_like(a0)
        alive, runs, k = np.flatnonzero(here.any(1)), here, 1  # runs: words of the places where k equal characters end
        here = runs = here[alive]
        while len(alive):
            longer = (runs[:, :-1] << one) & here[:, k:]
            goes_on = longer.any(1)
            done = ~goes_on
            held, to = runs[done], alive[done]
            least = np.where(held == 0, ~np.uint64(0), held & (~held + one)).min(1, initial=~np.uint64(0))
            i[to] = np.bitwise_count(least - one).astype(np.int64) - k + 1
            j[to] = ((held & least[:, None]) != 0).argmax(1)
            size[to] = k
            alive, runs, here, k = alive[goes_on], longer[goes_on], here[goes_on], k + 1
        np.add.at(total, own, size)
        some = size > 0
        own, a0, a1, b0, b1, i, j, size = (x[some] for x in (own, a0, a1, b0, b1, i, j, size))
        own, a0, a1, b0, b1 = np.r_[own, own], np.r_[a0, i + size], np.r_[i, a1], np.r_[b0, j + size], np.r_[j, b1]
        some = (a0 < a1) & (b0 < b1)
        own, a0, a1, b0, b1 = (x[some] for x in (own, a0, a1, b0, b1))
    return total


class Trie:
    """Keys by their prefixes, a level for each length. A node has the sign, its children in the level after (first, and how
    many), the lengths and the least ord of the keys below it, and the key that ends there (-1: none)."""

    def __init__(self, keys: list[str], signs: np.ndarray, ords: np.ndarray):
        rows = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        length = np.array([len(keys[i]) for i in rows.tolist()], np.int64)
        self.empty = rows[:1][length[:1] == 0]
        new, of = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        new[:1] = True
        self.levels, nodes = [], 1
        for depth in range(1, signs.shape[1] + 1):
            new[1:] |= signs[rows[1:], depth - 1] != signs[rows[:-1], depth - 1]
            long = np.flatnonzero(length >= depth)
            first = np.flatnonzero(new[long] | np.r_[True, long[1:] != long[:-1] + 1])
            start = long[first]
            children = np.searchsorted(of[start], np.arange(nodes + 1))
            least = np.minimum.reduceat(ords[rows[long]], first)
            shortest, longest = np.minimum.reduceat(length[long], first), np.maximum.reduceat(length[long], first)
            ends = np.where(length[start] == depth, rows[start], -1)
            few = (children[:-1], np.diff(children), shortest, longest, ends)  # half as wide, as keys may share few nodes
            first_child, many, shortest, longest, ends = (x.astype(np.int32) for x in few)
            self.levels.append((first_child, many, signs[rows[start], depth - 1], shortest, longest, least, ends))
            of[long], nodes = np.cumsum(np.isin(np.arange(len(long)), first)) - 1, len(first)

    def titles(self, at, size, full, top, place, beam: int | None):
        """(name, key, bound): keys whose common subsequence with a name lets them reach its `top` (as similar: with an ord below
        `place`). beam: only so many nodes of each level are followed for a name, those that promise most."""
        found = [(np.repeat(np.arange(len(size)), len(self.empty)), np.tile(self.empty, len(size)), np.zeros(len(size) * len(self.empty)))]
        todo = [(0, np.arange(len(size)), np.zeros(len(size), np.int64), full)] if self.levels else []
        while todo:
            depth, own, node, open_ = todo.pop()
            if len(own) > _WIDE:
                half = len(own) // 2
                todo += [(depth, own[half:], node[half:], open_[half:]), (depth, own[:half], node[:half], open_[:half])]
                continue
            first, many, sign, shortest, longest, least, ends = self.levels[depth]
            depth += 1
            n = many[node]
            own, open_ = np.repeat(own, n), np.repeat(open_, n)
            node = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(len(own))
            met = open_ & at[own, sign[node]]
            open_ = ((open_ + met) | (open_ - met)) & full[own]
            a, last = size[own], longest[node]
            common = a - np.bitwise_count(open_).astype(np.int64)
            early = (np.uint64(1) << np.maximum(a + depth - last, 0).astype(np.uint64)) - np.uint64(1)
            most = a - np.bitwise_count(open_ & early).astype(np.int64)  # the signs that are left can meet as many late characters of the name
            length = np.clip(most - common + depth, shortest[node], last)  # at which the bound is largest
            bound = 2.0 * np.minimum(most, common + length - depth) / (a + length)
            keep = np.flatnonzero((bound > top[own]) | ((bound == top[own]) & (least[node] < place[own])))
            if beam is not None and len(keep):
                keep = keep[np.lexsort((~open_[keep], -bound[keep], own[keep]))]  # then those whose characters come early in the name
                starts = np.flatnonzero(np.r_[True, own[keep][1:] != own[keep][:-1]])
                keep = keep[np.arange(len(keep)) - np.repeat(starts, np.diff(np.r_[starts, len(keep)])) < beam]
            own, node, open_ = own[keep], node[keep], open_[keep]
            stop = np.flatnonzero(ends[node] >= 0)
            found.append((own[stop], ends[node[stop]], 2.0 * common[keep[stop]] / (size[own[stop]] + depth)))
            if len(own) and depth < len(self.levels):
                todo.append((depth, own, node, open_))
        own, key, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = bound >= top[own]
        return own[keep], key[keep], bound[keep]


def _best_in_cells(batches):
    for frame in batches:
        for cell in frame.itertuples(index=False):
            block = TitleBlock(list(cell.keys), cell.ords)
            found = [(name, *best) for name, best in zip(cell.names, block.best_of_all(list(cell.names)), strict=True)]
            out = pd.DataFrame(found, columns=["name_key", "ratio", "at", "compared"])
            yield out.assign(title_key=[block.keys[j] for j in out["at"]], ord=block.ords[out["at"].to_numpy(np.int64)])[["name_key", "title_key", "ratio", "ord", "compared"]]


def _best_in_grid(names: DataFrame, titles: DataFrame, block: int) -> DataFrame:
    """name_key, title_key, ratio, ord, compared: the best title of each part of the titles for each name. Distinct keys spread over
    parts by their hash: `block` names meet in a task, or up to _MORE times as many if there are enough for all cores, and titles
    of _CHARS characters a name of `block`, which bounds the trie."""
    n, cores = names.count(), names.sparkSession.sparkContext.defaultParallelism
    rows = max(1, math.ceil(n / min(max(block, n // (8 * cores)), _MORE * block)))
    columns = max(1, math.ceil((titles.agg(F.sum(F.length("title_key"))).first()[0] or 0) / (_CHARS * block)))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = names.groupBy(place("name_key", rows).alias("i")).agg(F.collect_list("name_key").alias("names"))
    right = titles.groupBy(place("title_key", columns).alias("j")).agg(F.collect_list(F.struct("title_key", "ord")).alias("titles"))
    left = left.select("i", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"), "names")
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), "j", "titles")
    cells = left.hint("shuffle_hash").join(right, ["i", "j"]).repartitionById(rows * columns, F.col("i") * columns + F.col("j"))
    cells = cells.select("names", F.col("titles.title_key").alias("keys"), F.col("titles.ord").alias("ords"))
    return cells.mapInPandas(_best_in_cells, "name_key string, title_key string, ratio double, ord long, compared long")


def most_similar_titles(targets: DataFrame, titles: DataFrame, block: int = 1000) -> DataFrame:
    """For each target (name) the most similar of all titles (title, ord), then the first: name, title, ratio.

    Equal keys are compared once. A null title is empty; a null name, or any where there are no titles, has null; targets that
    repeat stay. Names that no title is near meet the titles in the grid, where bounds of prefixes leave out most of them; titles
    that share no prefixes and promise alike are still bounded one by one.
    """
    wanted = targets.select("name", F.when(F.col("name").isNotNull(), _key(F.col("name"))).alias("name_key"))
    place = F.struct(F.col("ord").cast("long").alias("ord"), "title")
    found = materialise(titles.groupBy(_key(F.col("title")).alias("title_key")).agg(F.min(place).alias("first")).select("title_key", "first.ord", "first.title"), "titles")
    names = materialise(wanted.where("name_key is not null").select("name_key").distinct(), "names")
    keys = found.select("title_key", "ord")
    most = max(_FEW, keys.count() // _SHARE)
    near = near_pairs(names.where(F.length("name_key") >= SHORTEST), keys, most).withColumn("ratio", F.pandas_udf(_ratio, "double")("name_key", "title_key")).where(F.col("ratio") >= NEAR)
    rank = F.struct("ratio", -F.col("ord"))
    near = materialise(near.join(keys, "title_key").groupBy("name_key").agg(F.max_by(F.struct("title_key", "ratio"), rank).alias("best")), "near")
    rest = materialise(names.join(near, "name_key", "left_anti"), "rest")
    discard(names)
    others = _best_in_grid(rest, keys, block).groupBy("name_key").agg(F.max_by(F.struct("title_key", "ratio"), rank).alias("best"))
    best = near.unionByName(others).select("name_key", "best.*").join(found.select("title_key", "title"), "title_key")
    return wanted.join(best, "name_key", "left").select("name", "title", "ratio")
