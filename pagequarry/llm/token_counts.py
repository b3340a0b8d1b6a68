"""Token counts by a finite-state transducer compiled from a byte-level BPE tokenizer's file; no token list is ever made.

Two machines in a row. The first cuts a text into pretokens. It is definite: whether a pretoken begins at a character depends
on the classes of the three characters before it and the two after it, so all places are decided at once, whatever came
earlier (`boundaries`). The classes are asked of the tokenizers library's own patterns.

The second one (`Transducer`) reads a pretoken's bytes. Every transition carries how many tokens more (or fewer) the text so
far has. It rests on two facts about byte pair encoding: a list of tokens is the encoding of its text exactly if every two
neighbours are (`Transducer.stands`), and so the encoding of a prefix is that of a shorter prefix plus one token. A state
holds what decides all later steps: the longest end of the text that begins a token and, for each place in it where a token
could yet begin, the token that ends there and how many tokens have come since. Transitions are worked out when first
needed and kept in a hash table of arrays; many pretokens advance together, a byte a step. When MAX_STATES states are held,
the table starts anew.

A pretoken's begin resets the second machine, so the state map of any stretch with a begin in it is constant there. Longer
pretokens are cut into chunks of CHUNK bytes. A chunk's state map is worked out for the entry states that occur: the reset
one, and those that the chunk before it leaves when reset. Maps are composed by a parallel prefix scan (`composed`), and maps
that lack the entry state which the scan asks for are extended, until all are known.

Supported are files of byte-level BPE with the library's own splitting pattern and without normalizer or dropout; anything
else is an error, not another count. Added tokens' strings in a text count as one token, as the library takes them.

Null texts count as empty: no bytes, no tokens. Repeated rows stay rows. Extra columns are left out. An empty table gives no
rows. Very long texts are read in pieces cut at single spaces between words, where nothing reaches across.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import chunks

LIMIT = 512
#: States held before the table starts anew; about 400 bytes each.
MAX_STATES = 200_000
#: Bytes of a pretoken that are one chunk.
CHUNK = 64
#: Characters of a text read at a time.
PIECE = 1_000_000
#: Rounds in which missing entries of state maps are worked out side by side; what is left then is walked.
ROUNDS = 6

OTHER, LETTER, NUMBER, BLANK, SPACE, UNKNOWN = range(6)
_transducers: dict[str, Transducer] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- pretokens ----------------------------------------------------------------------------------------------------


def character_classes(points: list[int]) -> np.ndarray:
    """Classes of code points, by the tokenizers library's own patterns."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    text, out = "".join(map(chr, points)), np.full(len(points), OTHER, dtype=np.uint8)
    for pattern, name in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK), (" +", SPACE)):
        inside = np.ones(len(points), dtype=bool)
        for _, (lo, hi) in Split(Regex(pattern), "removed").pre_tokenize_str(text):
            inside[lo:hi] = False
        out[inside] = name
    return out


def boundaries(points: np.ndarray, c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pretokens begin. points: code points of texts joined; c: their classes; first: where a text begins."""
    n = len(points)
    blank = c >= BLANK
    last = np.append(first[1:], True)
    before = np.concatenate(([OTHER], c[:-1]))
    before_blank = np.concatenate(([False], blank[:-1]))
    after_blank = np.append(blank[1:], False)
    begins = np.where(blank, ~before_blank | (~last & ~after_blank), np.where(before_blank, before == BLANK, before != c)) | first
    # Contractions: an apostrophe that begins a pretoken takes s, t, m, d, or re, ve, ll with it, and no more.
    for i in np.flatnonzero((points == 39) & begins & ~last):
        x = points[i + 1]
        if x in _ONE:
            size = 2
        elif i + 2 < n and not first[i + 2] and (int(x), int(points[i + 2])) in _TWO:
            size = 3
        else:
            continue
        begins[i + 1] = False
        if i + size < n:
            begins[i + size] = True
    return begins


_ONE = {ord(x) for x in "stmd"}
_TWO = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


# --- the transducer -----------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in files of byte-level vocabularies: itself if it shows, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Table:
    """Transitions from (state * 256 + byte) to next state and change of the count, in open addressing."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty one where it belongs."""
        mask = (1 << self.bits) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[at]
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held != -1)]
        return at

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are not there yet."""
        while 2 * (self.used + len(keys)) > 1 << self.bits:
            old = self.keys != -1
            held = self.keys[old], self.values[old]
            self.__init__(self.bits + 2)
            self.put(*held)
        while len(keys):
            at = self.slots(keys)
            _, one = np.unique(at, return_index=True)  # keys that want the same slot come one after the other
            self.keys[at[one]], self.values[at[one]] = keys[one], values[one]
            self.used += len(one)
            rest = np.ones(len(keys), dtype=bool)
            rest[one] = False
            keys, values = keys[rest], values[rest]


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or file.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        added = file.get("added_tokens") or []
        if any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens with conditions")
        strings = sorted((a["content"] for a in added if a["content"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None
        letters = byte_letters()
        spelled = lambda token: bytes(letters[c] for c in token)
        ids = {spelled(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = dict.fromkeys(self.of_byte, -1)  # rank of the merge that makes a token
        self.halves: dict[int, tuple[int, int]] = {}
        self.text: dict[int, bytes] = {t: bytes([b]) for b, t in enumerate(self.of_byte)}
        for r, (a, b) in enumerate(pairs):
            a, b = spelled(a), spelled(b)
            t = ids[a + b]
            if t in self.made:
                raise ValueError(f"{path}: a token with two merges")
            self.rank[ids[a], ids[b]], self.made[t], self.halves[t], self.text[t] = r, r, (ids[a], ids[b]), a + b
        self.ids = {x: t for t, x in self.text.items()}
        self.begins = {x[:k] for x in self.ids for k in range(1, len(x))}
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)  # filled as characters occur
        self.wholes: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [(b"", (0, -1, 0))]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.table = Table()

    def classes_of(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == UNKNOWN).any():
            new = np.unique(points[found == UNKNOWN])
            self.classes[new] = character_classes(new.tolist())
            found = self.classes[points]
        return found

    def stands(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are side by side.

        Seen backwards in time, the pieces at the seam are a's right ends and b's left ends. Two of them that lie there at
        once and have a merge earlier than the merges that use them up would have been joined. Of equal merges the left
        one comes first.
        """
        found = self.pairs.get((a, b))
        if found is None:
            x, y, x_used, y_used, found = a, b, 1 << 60, 1 << 60, True
            while found:
                r = self.rank.get((x, y))
                if r is not None and r < x_used and r <= y_used:
                    found = False
                elif self.made[x] > self.made[y]:
                    x_used, x = self.made[x], self.halves[x][1]
                elif self.made[y] >= 0:
                    y_used, y = self.made[y], self.halves[y][0]
                else:
                    break
            self.pairs[a, b] = found
        return found

    def whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        found = self.wholes.get(token)
        if found is None:
            parts = [self.of_byte[b] for b in self.text[token]]
            while len(parts) > 1:
                r, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
                if r == 1 << 60:
                    break
                parts[i : i + 2] = [self.ids[self.text[parts[i]] + self.text[parts[i + 1]]]]
            found = self.wholes[token] = parts == [token]
        return found

    def step(self, state: int, byte: int) -> int:
        """Next state * 256 + change of the count + 128. A state is an end of the text and, flat, triples of places in it:
        bytes from there to the end, the token that ends there (-1: none before it), tokens since."""
        end, marks = self.states[state]
        end += bytes([byte])
        last = change = None
        for i in range(0, len(marks), 3):
            token = self.ids.get(end[len(end) - marks[i] - 1 :])
            if token is not None and (marks[i + 1] < 0 or self.stands(marks[i + 1], token)) and self.whole(token):
                last, change = token, 1 - marks[i + 2]
                break
        if last is None:
            raise AssertionError("no token ends here")
        kept: list[int] = []
        for i in range(0, len(marks), 3):
            if end[len(end) - marks[i] - 1 :] in self.begins:
                kept += (marks[i] + 1, marks[i + 1], marks[i + 2] + change)
        kept += (0, last, 0)
        to = end[len(end) - kept[0] :], tuple(kept)
        number = self.numbers.get(to)
        if number is None:
            number = self.numbers[to] = len(self.states)
            self.states.append(to)
        return number << 8 | (change + 128)

    def advance(self, keys: np.ndarray) -> np.ndarray:
        """Values of transitions; those not known yet are worked out."""
        at = self.table.slots(keys)
        missing = np.flatnonzero(self.table.keys[at] != keys)
        if len(missing):
            new = np.unique(keys[missing])
            self.table.put(new, np.array([self.step(k >> 8, k & 255) for k in new.tolist()], dtype=np.int64))
            at = self.table.slots(keys)
        return self.table.values[at]

    def run(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and change of the count of each stretch of buf from its entry state; all advance a byte a step."""
        order = np.argsort(-sizes, kind="stable")
        at, n, state = starts[order], sizes[order], entries[order].astype(np.int64)
        count = np.zeros(len(order), dtype=np.int64)
        for k in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -k, side="left"))
            values = self.advance(state[:live] << 8 | buf[at[:live] + k])
            state[:live] = values >> 8
            count[:live] += (values & 255) - 128
        exits, counts = np.empty_like(state), np.empty_like(count)
        exits[order], counts[order] = state, count
        return exits, counts

    def count_long(self, data: bytes) -> int:
        """Tokens of one long pretoken, from the state maps of its chunks."""
        parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        kinds = {p: i for i, p in enumerate(dict.fromkeys(parts))}  # equal chunks have one map
        of = [kinds[p] for p in parts]
        seams = {pair: i for i, pair in enumerate(dict.fromkeys(zip(of, of[1:], strict=False)))}
        buf = np.frombuffer(b"".join(kinds), dtype=np.uint8)
        sizes = np.array([len(p) for p in kinds], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in kinds]  # of each kind: entry state to exit state and count

        def extend(wanted: set[tuple[int, int]]) -> None:
            todo = np.array(sorted((k, s) for k, s in wanted if s not in maps[k]), dtype=np.int64).reshape(-1, 2)
            exits, counts = self.run(buf, starts[todo[:, 0]], sizes[todo[:, 0]], todo[:, 1])
            for k, s, e, n in zip(todo[:, 0].tolist(), todo[:, 1].tolist(), exits.tolist(), counts.tolist(), strict=True):
                maps[k][s] = e, n

        extend({(k, 0) for k in range(len(kinds))})
        for _ in range(ROUNDS):
            extend({(b, e) for a, b in seams for e, _ in maps[a].values()})
            slots = [{s: i for i, s in enumerate(m)} for m in maps]
            unknown = max(map(len, maps))
            to = np.full((len(seams) + 1, unknown + 1), unknown)
            for (a, b), i in seams.items():
                to[i, : len(maps[a])] = [slots[b].get(e, unknown) for e, _ in maps[a].values()]
            counts = np.zeros((len(kinds), unknown + 1), dtype=np.int64)
            for k, m in enumerate(maps):
                counts[k, : len(m)] = [n for _, n in m.values()]
            path = [seams[pair] for pair in zip(of, of[1:], strict=False)] + [len(seams)]
            reached, totals = composed(to[path], counts[of])
            if len(of) == 1 or reached[-2, 0] != unknown:
                return int(totals[-1, 0])
        state = total = 0
        for k in of:
            extend({(k, state)})
            state, n = maps[k][state]
            total += n
        return total

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of whole texts."""
        if len(self.states) > MAX_STATES:
            self.reset()
        out = np.zeros(len(texts), dtype=np.int64)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for k, part in enumerate(self.added.split(t) if t and self.added else [t or ""]):
                out[i] += k > 0
                if part:
                    pieces.append(part)
                    owner.append(i)
        if not pieces:
            return out.tolist()
        joined = "".join(pieces)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        first = np.zeros(len(points), dtype=bool)
        lengths = np.array([len(p) for p in pieces])
        begins_of = np.cumsum(lengths) - lengths
        first[begins_of] = True
        begins = np.flatnonzero(boundaries(points, self.classes_of(points), first))
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        ends = np.cumsum(width)
        starts = ends[begins] - width[begins]
        sizes = np.diff(np.append(starts, ends[-1]))
        data = joined.encode()
        buf = np.frombuffer(data, dtype=np.uint8)
        text = np.array(owner)[np.searchsorted(begins_of, begins, side="right") - 1]
        short = sizes <= CHUNK
        _, counts = self.run(buf, starts[short], sizes[short], np.zeros(int(short.sum()), dtype=np.int64))
        out += np.bincount(text[short], weights=counts, minlength=len(texts)).astype(np.int64)
        for s, n, i in zip(starts[~short].tolist(), sizes[~short].tolist(), text[~short].tolist(), strict=True):
            out[i] += self.count_long(data[s : s + n])
        return out.tolist()


def composed(to: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix compositions of state maps and sums of their counts, by a scan that doubles its reach each step.

    Row i of `to` maps an entry state to an exit state; the result's row i maps the entry of row 0 to the exit of row i.
    """
    to, counts, reach = to.copy(), counts.copy(), 1
    while reach < len(to):
        head, tail = to[:-reach], to[reach:]
        counts[reach:] = counts[:-reach] + np.take_along_axis(counts[reach:], head, axis=1)
        to[reach:] = np.take_along_axis(tail, head, axis=1)
        reach *= 2
    return to, counts


def transducer(path: str) -> Transducer:
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def pieces_of(text: str) -> Iterator[str]:
    """A text in pieces of PIECE characters or more, cut before a space between two characters that are no blanks."""
    lo = 0
    while len(text) - lo > PIECE:
        hi = text.find(" ", lo + PIECE)
        while 0 <= hi < len(text) - 1 and (text[hi - 1].isspace() or text[hi + 1].isspace()):
            hi = text.find(" ", hi + 1)
        if not 0 <= hi < len(text) - 1:
            break
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs."""
    path = path or tokenizer_path()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for part in parts:
            texts = [t if isinstance(t, str) else None for t in part["text"].tolist()]
            for lo, hi in chunks(texts):
                if hi - lo == 1 and texts[lo] and len(texts[lo]) > PIECE and not (machine.added and machine.added.search(texts[lo])):
                    n = [sum(machine.count([p])[0] for p in pieces_of(texts[lo]))]
                else:
                    n = machine.count(texts[lo:hi])
                yield pd.DataFrame({"doc_id": part["doc_id"].iloc[lo:hi].to_numpy(), "n_bytes": part["n_bytes"].iloc[lo:hi].to_numpy(), "n_tokens": n})

    # The id goes as text: a null among numbers would make pandas round them.
    rows = docs.select(F.col("doc_id").cast("string"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = rows.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return found.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
