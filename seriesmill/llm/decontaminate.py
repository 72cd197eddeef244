"""Benchmark items in documents, also with other numbers, names and units."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# Words that are units where they follow a number.
UNITS = frozenset(
    "% mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams ton tons tonne tonnes lb lbs pound "
    "pounds oz ounce ounces ml cl l litre litres liter liters gallon gallons s sec second seconds min minute minutes h "
    "hour hours day days week weeks month months year years $ € £ dollar dollars euro euros cent cents percent mph kmh "
    "hz khz mhz ghz kb mb gb tb w kw v a °c °f degree degrees".split())
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
# Numbers written as words, also with a hyphen between them.
_ONES = "one two three four five six seven eight nine"
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety"
NUMBER_WORDS = frozenset(
    f"zero {_ONES} {_TENS} ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen dozen hundred "
    "thousand million billion trillion".split()) | {f"{t}-{o}" for t in _TENS.split() for o in _ONES.split()}
# Signs that are units also before a number.
SIGNS = "$€£"
ORDINAL = re.compile(r"\d[\d,]*(?:st|nd|rd|th)")
#: A number with something written to it: a currency before, anything behind.
ATTACHED = re.compile(rf"((?:[^\W\d_]{{0,3}}[{SIGNS}])?)([+-]?\d(?:[\d.,:/]*\d)?)(?:[-–—](?=\w))?(.*)")
EDGES = re.compile(r"^[^\w%$€£°]+|[^\w%$€£°]+$")
# MAYBE: a capitalised word that starts a sentence or line, a name in one reading and itself in the other
NUM, NAME, UNIT, MAYBE = 1, 2, 3, 4
#: Placeholders as they stand in a template.
SHOWN = {NUM: "<num>", NAME: "<name>", UNIT: "<unit>"}
# KNOWN: some item has the word
EMPTY, ENDS, CAPITAL, DIGITS, MEASURE, SIGN, PARTS, KNOWN = 1, 2, 4, 8, 16, 32, 64, 128
#: Marks for pairs of words, hashed.
PAIR_BITS = 1 << 22
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Words a task remembers; beyond, it forgets them all and goes on.
REMEMBERED = 400_000
#: Characters of text that a task reads at once; a longer text is read alone.
AT_ONCE = 4_000_000
# Places that words share: plain ones that no item has by ENDS and CAPITAL, the end of a text, and no word at all.
OTHER, BREAK, NOTHING, SHARED = 0, 4, 5, 6
MARKS = ".,!?;:"
#: Words that are told by their letters alone: those of scripts in which one small letter answers one capital.
SIMPLE = rf"^[A-ZÀ-ÖØ-ÞА-ЯЁa-zß-öø-ÿа-яё][a-zß-öø-ÿа-яё]*[{MARKS}]?$"
SIMPLE_CAPITAL = "^[A-ZÀ-ÖØ-ÞА-ЯЁ]"
#: Benchmark windows up to which their hashes go to every task; beyond, all windows are exchanged.
SENT = 2_000_000


def _parts(raw: str, core: str) -> list[str]:
    """What a word with a number and something written to it consists of; other words: nothing."""
    found = ATTACHED.fullmatch(core) if core else None
    if not found:
        return []
    sign, number, rest = found.groups()
    parts = [p for p in (sign, number, rest) if p]
    if len(parts) < 2:
        return []
    # what stands around the core, such as the end of a sentence, stays where it is
    at = raw.index(core)
    parts[0] = raw[:at] + parts[0]
    parts[-1] += raw[at + len(core):]
    return parts


class Places(dict):
    """A word's place in the table of words met; new ones are added.

    With ``telling``, the words that items have, number words and units, all
    other words in small letters share two places: OTHER + 1 where a mark behind
    the word ends a sentence, else OTHER.
    """

    def __init__(self, add, telling: frozenset[str] | None):
        super().__init__()
        self.add, self.telling = add, telling

    def __missing__(self, raw: str) -> int:
        if self.telling is not None and raw.islower():
            last = raw[-1]
            core = raw if last.isalpha() else raw[:-1] if last in MARKS else ""
            if core.isalpha() and core not in self.telling:
                self[raw] = place = OTHER + (last in ".!?:")
                return place
        return self.add(raw)


class Templates:
    """Cuts texts into words, types them, and hashes windows; one per task.

    ``known`` are the words that items have and ``pairs`` those that follow each
    other in a window of theirs, if only windows matter that an item can have
    too: others are passed over before any reading is made of them.
    """

    def __init__(
        self, window: int, known: frozenset[str] | None = None, pairs: list[tuple[str, str]] | None = None,
    ):
        self.window = window
        self.known = known
        self.telling = None if known is None else known | NUMBER_WORDS | UNITS
        self.places = Places(self._new, self.telling)
        self.words: list[str] = []
        self.pairs = None
        if pairs is not None:
            hashes = np.array([[xxhash.xxh64_intdigest(w) for w in pair] for pair in pairs], np.uint64).reshape(-1, 2)
            self.pairs = np.zeros(PAIR_BITS, bool)
            self.pairs[_pair(hashes[:, 0], hashes[:, 1])] = True
        self.parts: dict[int, list[int]] = {}
        self.flags = np.zeros(1024, np.uint8)
        self.hashes = np.zeros(1024, np.uint64)
        self.typed = np.array([0] + [xxhash.xxh64_intdigest(SHOWN[k]) for k in (NUM, NAME, UNIT)], np.uint64)
        self.subsets: dict[tuple[int, int], tuple[int, ...]] = {}
        self._forget()

    def _forget(self) -> None:
        """Start anew, with the places that words share."""
        self.places.clear()
        self.places[""] = NOTHING
        self.parts.clear()
        self.words = [""] * SHARED
        self.flags[:SHARED] = 0, ENDS, CAPITAL, CAPITAL | ENDS, ENDS, EMPTY
        self.hashes[:SHARED] = 0

    def _new(self, raw: str) -> int:
        last = raw[-1]
        core = raw if last.isalpha() else raw[:-1] if last in MARKS else ""
        if core.isalpha():  # most words: letters, and a mark behind them perhaps
            word = core.lower()
            flags = (word in NUMBER_WORDS) * DIGITS | (word in UNITS) * MEASURE | (last in ".!?:") * ENDS
            flags |= (core[0].isupper() and core[1:].islower()) * CAPITAL
        else:
            core = EDGES.sub("", raw)
            word = core.lower()
            flags = (not word) * EMPTY | (raw[-1:] in ".!?:" or len(raw) > 1 and raw[-2] in ".!?") * ENDS
            flags |= (core[:1].isupper() and core[1:].islower()) * CAPITAL
            number = word in NUMBER_WORDS or bool(NUMBER.fullmatch(word) or ORDINAL.fullmatch(word))
            flags |= number * DIGITS | (word in UNITS) * MEASURE | (word[-1:] in SIGNS and bool(word)) * SIGN
            parts = [] if number else _parts(raw, core)
            if parts:
                flags |= PARTS
        place = self.places[raw] = len(self.words)
        if place == len(self.flags):
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.words.append(word)
        self.hashes[place] = 0
        if self.known is None or word in self.known:
            flags |= KNOWN
            self.hashes[place] = xxhash.xxh64_intdigest(word.encode())
        self.flags[place] = flags
        if flags & PARTS:
            self.parts[place] = [q for part in parts for q in self._split(part)]
        return place

    def _split(self, raw: str) -> list[int]:
        place = self.places[raw]
        return self.parts.get(place, [place])

    def _placed(self, raw: pa.Array) -> np.ndarray:
        """The places of distinct words."""
        out = np.zeros(len(raw), np.int32)
        rest = np.ones(len(raw), bool)
        if self.telling is not None:
            bare = pc.ascii_rtrim(raw, MARKS)
            cores = pc.utf8_lower(bare).to_numpy(zero_copy_only=False)
            told = np.fromiter(map(self.telling.__contains__, cores), bool, len(cores))
            rest = told | ~_bools(pc.match_substring_regex(raw, SIMPLE))
            # a capital alone is no name
            capital = _bools(pc.match_substring_regex(raw, SIMPLE_CAPITAL)) & (pc.utf8_length(bare).to_numpy() > 1)
            out[:] = OTHER + _bools(pc.match_substring_regex(raw, "[.!?:]$")) + 2 * capital
        left = raw.filter(pa.array(rest)).to_numpy(zero_copy_only=False)
        out[rest] = np.fromiter(map(self.places.__getitem__, left), np.int32, len(left))
        return out

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Per word its place in ``words`` and its type (0: itself)."""
        places, types, _ = self.read_all([text])
        return places[:-1], types[:-1]

    def read_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, Callable[[int], str]]:
        """Per word of all texts its place in ``words`` and its type (0: itself), with a BREAK behind each
        text; and what gives the word as it is written for where it stands.

        A number is a number, in digits, as an ordinal or as a word; a unit is a
        unit word after one, or a currency sign next to one; a name is a
        capitalised word, or MAYBE one where a sentence or line starts.  What is written
        to a number ('$12', '20%', '5km') is a word of its own.
        """
        if len(self.places) > REMEMBERED:
            self._forget()
        # a line's first word is like a sentence's
        lines = pc.replace_substring(pa.array([text or "" for text in texts], pa.large_string()), "\n", " . ")
        split = pc.utf8_split_whitespace(lines)
        raw = split.flatten().dictionary_encode()
        # every distinct word is looked at once
        codes = np.insert(raw.indices.to_numpy(), split.offsets.to_numpy()[1:], -1)
        places = np.append(self._placed(raw.dictionary), np.int32(BREAK))[codes]
        flags = self.flags[places]
        cut = flags & PARTS > 0
        if cut.any():
            parts = [self.parts[p] for p in places[cut].tolist()]
            times = np.ones(len(places), np.int64)
            times[cut] = [len(p) for p in parts]
            places, codes, cut = (np.repeat(x, times) for x in (places, codes, cut))
            places[cut] = np.concatenate(parts)
            flags = self.flags[places]
        starts = np.ones(len(places), bool)
        starts[1:] = flags[:-1] & ENDS > 0
        full = np.flatnonzero(flags & EMPTY == 0)
        # an empty word, such as a lone dash, hands on whether a sentence starts
        sums = np.concatenate([[0], np.cumsum(starts)])
        starts = sums[full + 1] > sums[np.concatenate([[0], full[:-1] + 1])]
        places, flags, codes = places[full], flags[full], codes[full]
        number = flags & DIGITS > 0
        after = np.zeros(len(places), bool)
        after[1:] = number[:-1]
        types = np.zeros(len(places), np.uint8)
        types[flags & CAPITAL > 0] = NAME
        types[(flags & CAPITAL > 0) & starts] = MAYBE
        types[(flags & MEASURE > 0) & after] = UNIT
        before = np.zeros(len(places), bool)
        before[:-1] = number[1:]
        types[(flags & SIGN > 0) & (before | after)] = UNIT
        types[number] = NUM
        return places, types, lambda at: raw.dictionary[int(codes[at])].as_py()

    def tell(self, places: np.ndarray, at: int, size: int, written: Callable[[int], str]) -> None:
        """Gives words of a window that share a place one of their own."""
        for k in np.flatnonzero(places[at:at + size] < BREAK).tolist():
            places[at + k] = self.places[written(at + k)]

    def hashed(self, places: np.ndarray, types: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Readings of the windows of ``size`` words: -1 for the words as they are, else a template whose
        bits tell which offsets are names where they are MAYBE one; with places and hashes.

        Templates that say too little are left out: under two plain words, or no placeholder.
        """
        known = self.flags[places] & KNOWN > 0
        # windows of words that items have or that stand behind a placeholder
        possible = _everywhere(known | (types > 0), size)
        if not possible.any():
            return
        if size > 1 and self.pairs is not None:
            # pairs are looked up where they can matter only
            follow = np.zeros(len(places) - 1, bool)
            for k in range(size - 1):
                follow[k:k + len(possible)] |= possible
            first = np.flatnonzero(follow)
            plain, kinds, types_ = self._hashes(places, types, first)
            plain_, kinds_, next_ = self._hashes(places, types, first + 1)
            follow[first] = (self.pairs[_pair(plain, plain_)] | self.pairs[_pair(kinds, kinds_)]
                             | (types_ == MAYBE) | (next_ == MAYBE))
            possible &= _everywhere(follow, size - 1)
        possible = np.flatnonzero(possible)
        if not len(possible):
            return
        # a row per window
        window = possible[:, None] + np.arange(size)
        plain, kinds, kind = self._hashes(places, types, window)
        whole = known[window].all(1)
        yield -1, possible[whole], _mixed(_totals(plain[whole]))
        sure = (kind > 0) & (kind < MAYBE)
        slots, most = sure.sum(1), size - min(2, size)
        some = (slots > 0) & (slots <= most)
        yield 0, possible[some], _mixed(_totals(kinds[some]))
        # each MAYBE is a name or itself, so a window has as many readings as they have subsets
        maybe = kind == MAYBE
        could = maybe.any(1)
        if not could.any():
            return
        possible, maybe, slots = possible[could], maybe[could], slots[could]
        totals = _totals(kinds[could])
        patterns = (maybe << np.arange(size)).sum(1)
        gains = self.typed[NAME] - plain[could]
        for mask in sorted({m for p in np.unique(patterns).tolist() for m in self._subsets(p, most)}):
            chosen = (patterns & mask == mask) & (slots + mask.bit_count() <= most)
            if not chosen.any():
                continue
            with np.errstate(over="ignore"):
                total = totals[chosen]
                for k in range(size):
                    if mask >> k & 1:
                        total = total + gains[chosen, k] * _power(size - 1 - k)
            yield mask, possible[chosen], _mixed(total)

    def _hashes(self, places: np.ndarray, types: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of words as they are, and as placeholders where they are surely one, and the words' types."""
        plain, types = self.hashes[places[at]], types[at]
        return plain, np.where((types > 0) & (types < MAYBE), self.typed[types % MAYBE], plain), types

    def _subsets(self, pattern: int, most: int) -> tuple[int, ...]:
        """The subsets of at most ``most`` of the bits set, without the empty one."""
        found = self.subsets.get((pattern, most))
        if found is None:
            out, m = [], pattern
            while m:
                if m.bit_count() <= most:
                    out.append(m)
                m = (m - 1) & pattern
            found = self.subsets[pattern, most] = tuple(out)
        return found

    def able(self, types: np.ndarray, size: int) -> np.ndarray:
        """Whether a window keeps two plain words, and can so match as a template, in every reading."""
        out = _counts(types > 0, size) <= size - min(2, size)
        return out if out.any() else ~out

    def window_at(self, places: np.ndarray, types: np.ndarray, at: int, size: int, reading: int) -> tuple:
        """The window's text in a reading, and the words behind its placeholders."""
        words = [self.words[p] for p in places[at:at + size]]
        if reading < 0:
            return " ".join(words), []
        kinds = [(NAME if reading >> j & 1 else 0) if k == MAYBE else k for j, k in enumerate(types[at:at + size].tolist())]
        shown = [SHOWN[k] if k else w for w, k in zip(words, kinds, strict=True)]
        return " ".join(shown), [f"{k}{w}" for w, k in zip(words, kinds, strict=True) if k]


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where two words that follow each other are marked."""
    with np.errstate(over="ignore"):
        return (_mixed(first * FACTOR + second) & np.uint64(PAIR_BITS - 1)).astype(np.int64)


def _bools(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


def _everywhere(flags: np.ndarray, size: int) -> np.ndarray:
    """Whether all are set, per window."""
    out = flags[:max(len(flags) - size + 1, 0)].copy()
    for k in range(1, size):
        out &= flags[k:k + len(out)]
    return out


def _totals(values: np.ndarray) -> np.ndarray:
    """A hash per row of hashes."""
    total = np.zeros(len(values), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(values.shape[1]):
            total = total * FACTOR + values[:, k]
    return total


def _mixed(total: np.ndarray) -> np.ndarray:
    return total ^ (total >> np.uint64(29))


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(FACTOR), k, 1 << 64))


def _counts(flags: np.ndarray, size: int) -> np.ndarray:
    """How many are set, per window."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[size:] - sums[:-size]


WINDOWS = "size int, at int, n int, template boolean, hash long, window string, slots array<string>, able boolean, ables int"
#: Of an item its words' types, of a document those around a window, and how many come before it.
WINDOWS += ", kinds string, lead int"


def _windows(
    rows: DataFrame, sizes: list[int], only: np.ndarray | None, known: frozenset[str] | None, longest: int | None,
    pairs: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Windows of the rows' texts (``key`` passes through); those with a hash in ``only``, if given.

    Without ``longest`` the texts are items: one window size per text, the
    largest it has room for.  Else they are documents, and ``longest`` is the
    number of words of the longest item.
    """
    items = longest is None
    keep = None
    if only is not None:
        only = np.sort(only)
        keep = np.zeros(1 << 22, bool)
        keep[(only & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(sizes[-1], known, pairs)
        columns = ["key", "copy", "size", "at", "n", "template", "hash", "window", "slots", "able", "ables", "kinds", "lead"]
        for frame in frames:
            out = []
            texts, keys, copies = frame["text"].tolist(), frame["key"].tolist(), frame["copy"].tolist()
            for some in _at_once(texts):
                places, types, written = templates.read_all(texts[some])
                ends = np.flatnonzero(places == BREAK)
                begins = np.concatenate([[0], ends[:-1] + 1])
                # what an item is judged by; documents need not know
                judged = []
                for begin, end in zip(begins.tolist(), ends.tolist(), strict=True) if items else ():
                    fit = ([s for s in sizes if s <= end - begin] or [0])[-1]
                    able = templates.able(types[begin:end], fit) if fit else np.zeros(0, bool)
                    judged.append((fit, able, int(able.sum()), _shown(types[begin:end])))
                for size in sizes:  # a window with a BREAK is of no text
                    for reading, at_, hashes in templates.hashed(places, types, size):
                        if keep is not None:
                            found = np.flatnonzero(keep[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
                            spot = np.minimum(np.searchsorted(only, hashes[found]), len(only) - 1)
                            found = found[only[spot] == hashes[found]]
                        else:
                            found = np.arange(len(hashes))
                        at_, hashes = at_[found], hashes[found].astype(np.int64).tolist()
                        for at, k, hash_ in zip(at_.tolist(), np.searchsorted(ends, at_).tolist(), hashes, strict=True):
                            row, begin, end = some.start + k, int(begins[k]), int(ends[k])
                            if items:
                                fit, able, ables, kinds = judged[k]
                                if fit != size:
                                    continue
                                able, first = bool(able[at - begin]), begin
                            else:
                                first = max(begin, at - longest)
                                able, ables, kinds = False, 0, _shown(types[first:min(end, at + size + longest)])
                            templates.tell(places, at, size, written)
                            shown, slots = templates.window_at(places, types, at, size, reading)
                            out.append((keys[row], copies[row], size, at - begin, end - begin, reading >= 0, hash_,
                                        shown, slots, able, ables, kinds, at - first))
                            if len(out) > 50_000:
                                yield pd.DataFrame(out, columns=columns)
                                out = []
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, f"key string, copy long, {WINDOWS}")


def _shown(types: np.ndarray) -> str:
    """Types as text, one figure per word."""
    return (types + 48).astype(np.uint8).tobytes().decode()


def _at_once(texts: list[str | None]) -> Iterator[slice]:
    """Texts that follow each other, of AT_ONCE characters in all or one."""
    start = size = 0
    for k, text in enumerate(texts):
        more = len(text or "")
        if size and size + more > AT_ONCE:
            yield slice(start, k)
            start, size = k, 0
        size += more
    if start < len(texts):
        yield slice(start, len(texts))


def _rows(table: DataFrame, key: str, text: str) -> DataFrame:
    return table.select(F.col(key).cast("string").alias("key"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))


def _alike(a: str, b: str) -> bool:
    """Whether two words can be of one type; MAYBE is a name or none."""
    return a == b or str(MAYBE) in (a, b) and {a, b} <= {"0", str(NAME), str(MAYBE)}


def _words(found: dict[int, tuple], kinds: str, size: int) -> int:
    """How many of an item's words a place of a document has.

    Those of the windows found, and beside them placeholders in place: from a
    window outwards, as long as the types of both texts agree word by word.
    """
    words = np.zeros(len(kinds), bool)
    for place in found:
        words[place:place + size] = True
    for back in (True, False):
        for place in sorted(found, reverse=not back):
            around, lead = found[place][1:]
            i, j, step = (place - 1, lead - 1, -1) if back else (place + size, lead + size, 1)
            while 0 <= i < len(kinds) and 0 <= j < len(around) and not words[i] and _alike(kinds[i], around[j]):
                if kinds[i] == "0" or around[j] == "0":
                    # a plain word is not compared here, so it does not count
                    i, j = i + step, j + step
                    continue
                words[i] = True
                i, j = i + step, j + step
    return int(words.sum())


def _covered(hits: list, n: int, size: int, ables: int, kinds: str, share: float = 0.0) -> tuple[float, bool]:
    """Largest share of an item at one place with consistent slots, and whether slots differ.

    ``hits``: (place in document, place in item, template, item slots, document
    slots, able, types around, words before).  A place is a stretch of at most
    1.25 item lengths.  Within it each item word behind a placeholder must stand
    for one word of the document, and the other way round; windows that break
    this do not count.

    The share is that of all windows or that of the ``ables``, which can match as
    templates, whichever is larger, as other windows cannot match where a slot
    has changed; and it is at most the share of the item's words that are there
    (``_words``).  So an item of little but numbers or names is not found by the
    few plain words it has.
    """
    hits = sorted(hits, key=lambda h: (h[0], h[1], h[2]))
    span, total = n + n // 4, n - size + 1
    # the densest stretches first; the first that cannot be beaten ends the search
    ends, end = [], 0
    for start in range(len(hits)):
        end = max(end, start)
        while end < len(hits) and hits[end][0] - hits[start][0] <= span - size:
            end += 1
        ends.append(end)
    best = (0.0, False)
    for start in sorted(range(len(hits)), key=lambda k: k - ends[k]):
        if min(1.0, (ends[start] - start) / ables) <= best[0]:
            break
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        found: dict[int, tuple] = {}
        changed = False
        # the readings of a window with the fewest placeholders first
        for _, place, template, ours, theirs, able, around, lead in sorted(
                hits[start:ends[start]], key=lambda h: (h[2], h[0], len(h[3]))):
            if not template:
                found[place] = (able, around, lead)
                continue
            if any(there.get(a, b) != b or back.get(b, a) != a for a, b in zip(ours, theirs, strict=True)):
                continue
            there.update(zip(ours, theirs, strict=True))
            back.update(zip(theirs, ours, strict=True))
            changed |= list(ours) != list(theirs)
            found[place] = (able, around, lead)
        covered = max(len(found) / total, sum(f[0] for f in found.values()) / ables)
        if covered > best[0] and covered >= share:
            covered = min(covered, _words(found, kinds, size) / n)
        if covered > best[0]:
            best = (covered, changed)
    return best


JUDGED = "key string, copy long, item string, covered double, changed boolean"


def _judged(
    docs: DataFrame, benchmark: DataFrame, window: int = 5, share: float = 0.8, least: int = 3,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    sent: int = SENT,
) -> DataFrame:
    """``contaminated`` by row: id (``key``) and hash of the text (``copy``)."""
    sizes = sorted({*range(min(least, window), window), window})
    items = stored(_windows(_rows(benchmark, item_id, item_text), sizes, None, None, None))
    count, longest = items.agg(F.count(F.lit(1)), F.max("n")).first()
    if not count:
        return docs.sparkSession.createDataFrame([], JUDGED)
    only = known = pairs = None
    if count <= sent:
        only = np.array([r["hash"] for r in items.select("hash").distinct().collect()], np.int64).view(np.uint64)
        words = items.where("NOT template").select(F.explode(F.split("window", " ")).alias("word")).distinct()
        known = frozenset(r["word"] for r in words.collect())
        shown = F.split("window", " ")
        follow = items.select(F.explode(F.arrays_zip(
            F.slice(shown, F.lit(1), F.size(shown) - 1).alias("a"), F.slice(shown, F.lit(2), F.size(shown) - 1).alias("b")
        )).alias("pair")).select("pair.*").distinct()
        pairs = [(r["a"], r["b"]) for r in follow.collect()]
    used = [r["size"] for r in items.select("size").distinct().collect()]
    same = ["hash", "size", "template", "window"]
    theirs = stored(_windows(_rows(docs, doc_id, text), sorted(used), only, known, longest, pairs).select(
        "key", "copy", *same, "at", "slots", "kinds", "lead"))
    ours = items.select(
        *same, F.col("key").alias("item"), F.col("copy").alias("item_copy"),
        F.col("at").alias("place"), F.col("n").alias("item_n"), F.col("slots").alias("item_slots"), "able", "ables",
        F.col("kinds").alias("item_kinds"))
    one, pair = ["item", "item_copy"], ["key", "copy", "item", "item_copy"]
    # An item needs ``share`` of its windows, so a document that has them has one of any few of the rest: the
    # rarest ones lead to it.  Only pairs that share one of those are looked at, however common the others are.
    often = theirs.groupBy(*same).agg(F.count(F.lit(1)).alias("often"))
    places = ours.join(often, same, "left").groupBy(*one, "place", "item_n", "size", "ables").agg(
        F.coalesce(F.sum("often"), F.lit(0)).alias("often"))
    spare = F.col("item_n") - F.col("size") + 1 - F.ceil(F.lit(share) * F.col("ables"))
    rare = places.withColumn("nth", F.row_number().over(
        Window.partitionBy(*one).orderBy("often", "place"))).where(F.col("nth") <= spare + 1)
    leads = _meet(ours.select(*same, *one, "place"), rare.select(*one, "place"), [*one, "place"]).select(
        *same, *one).distinct()
    pairs = stored(theirs.select("key", "copy", *same).distinct().join(leads, same).select(*pair).distinct())
    hits = _meet(_meet(theirs, pairs, ["key", "copy"]), ours, [*same, *one])
    gathered = hits.groupBy(*pair, "item_n", "size", "ables", "item_kinds").agg(
        F.count_distinct("place").alias("places"),
        F.collect_list(F.struct("at", "place", "template", "item_slots", "slots", "able", "kinds", "lead")).alias("hits")
    ).where(F.col("places") >= F.lit(share) * F.col("ables"))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            judged = [
                _covered([(h["at"], h["place"], h["template"], h["item_slots"], h["slots"], h["able"], h["kinds"], h["lead"])
                          for h in hs], n, size, ables, kinds, share)
                for hs, n, size, ables, kinds in zip(
                    frame["hits"], frame["item_n"], frame["size"], frame["ables"], frame["item_kinds"], strict=True)]
            yield pd.DataFrame({
                "key": frame["key"], "copy": frame["copy"], "item": frame["item"],
                "covered": [c for c, _ in judged],
                "changed": [x for _, x in judged]})

    return gathered.mapInPandas(judge, JUDGED).where(F.col("covered") >= share)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                 **settings) -> DataFrame:
    """``doc_id, item_id, covered, changed``: documents that hold ``share`` of an item's windows or more,
    or of those that keep two plain words and can so match as templates.

    Texts become templates: numbers, names and units turn into typed
    placeholders; a capitalised word that starts a sentence is read both as a
    name and as itself.  Windows of ``window`` words, as they are and as templates,
    are joined by hash and compared in full.  What a document and an item share
    then counts at one place of the document, and only with consistent slots:
    each of the item's words behind a placeholder stands for one word there and
    the other way round.  Numbers, names and units beside a window count where
    they stand in place, and no less than ``share`` of the item's words must be
    there in all, so an item of little but numbers is not found by a common
    phrase.  ``changed`` tells a re-parameterised item from a copy.

    Items of fewer words than ``window`` are one window; those under ``least``
    words, and NULL texts, are in no document.  NULL ids pass through.  Rows
    that share an id are judged one by one; the best counts.  Extra columns are
    not read; an empty table on either side gives no rows.

    A task drops windows with a word, a pair of words or a hash that no item has.
    For that it gets the items' words, pairs and hashes, if there are at most ``sent`` windows; with more,
    every window is exchanged, which gives the same rows.  Of an item's windows
    the rarest in the documents lead to the pairs that are looked at, so a phrase
    that a third of the documents share with many items costs no pairs.
    """
    judged = _judged(docs, benchmark, doc_id=doc_id, item_id=item_id, **settings)
    best = judged.groupBy("key", "item").agg(
        F.max(F.struct("covered", (~F.col("changed")).alias("same"))).alias("best"))
    return best.select(
        F.col("key").cast(docs.schema[doc_id].dataType).alias("doc_id"),
        F.col("item").cast(benchmark.schema[item_id].dataType).alias("item_id"),
        F.col("best.covered").alias("covered"), (~F.col("best.same")).alias("changed"))


def _meet(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``others`` on equal values, NULLs included, and the rest of the columns of both."""
    others = others.withColumnsRenamed({c: f"__{c}" for c in on})
    met = rows.join(others, on=_all([F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]))
    return met.drop(*[f"__{c}" for c in on])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all columns.

    Rows go by id and text: a clean row stays, whatever other rows share its id or have none.
    """
    gone = _judged(docs, benchmark, doc_id=doc_id, text=text, **settings).select(
        F.col("key").cast(docs.schema[doc_id].dataType).alias("__gone"), F.col("copy").alias("__copy")).distinct()
    same = docs[doc_id].eqNullSafe(F.col("__gone")) & (F.xxhash64(docs[text]) == F.col("__copy"))
    return docs.join(gone, same, "left_anti")
