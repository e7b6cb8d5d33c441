"""BPE encoding and decoding by a tokenization automaton.

The merge list is compiled into a deterministic automaton over token labels by adding one merge
gadget after another. It starts as one state that loops on every base symbol. The gadget of a merge
(u, v) -> w takes the state s that arcs labelled u lead to; if s has an arc v, then s gets a copy
without that arc, u-arcs lead to the copy from then on, and every state with a u-arc gets a w-arc to
where s went by v. After all gadgets the automaton's one path that spells a word is the word's BPE
segmentation. A copy is stored as (parent, removed label, birth), so the automaton has one state a
merge at most; arcs of a copy are its parent's. Copies form a tree, numbered in depth-first order, so
that "was label x removed on the way from the root to state s" is one search in a sorted list.

Encoding a word is one scan over its symbols from left to right. Every prefix has one path that spells
it, so a prefix is told by the state and last label of its path: the label is the one that ends here and
whose beginning's state has an arc for it. Labels that end at a symbol are found in a tree of labels read
backwards, states and arcs in the transition table. Of that table, of states by labels, the rows and
entries that words reach are filled in when first met. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the tokenizer file's own pre-tokenizer pattern says.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same over lower-case ASCII.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"
SUFFIX = "</w>"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Where a table row keeps its state's number.
STATE = None


class Automaton:
    """The tokenization automaton of a merge list over base symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = vocab
        parent, removed, state = [-1], [""], {}
        self.left: dict[str, tuple[str, int]] = {}
        base = set(vocab) - {a + b for a, b in merges}
        for x in base:
            state[x] = 0
        born = [0]
        for time, (u, v) in enumerate(merges, 1):
            w = u + v
            if w in self.left or w in base or u not in state or v not in state:
                continue
            s, t = state[u], state[v]
            self.left[w] = (u, time)
            state[w] = t
            parent.append(s)
            removed.append(v)
            born.append(time)
            state[u] = len(parent) - 1
        self.state = state
        self._number(parent, removed, born)
        self.tree = self._tree()
        self.table: dict[int, dict] = {}

    def _number(self, parent: list[int], removed: list[str], born: list[int]) -> None:
        children: list[list[int]] = [[] for _ in parent]
        for s, p in enumerate(parent):
            if p >= 0:
                children[p].append(s)
        self.enter, self.leave = [0] * len(parent), [0] * len(parent)
        clock, stack = 0, [(0, 0)]
        while stack:
            s, k = stack.pop()
            if k == 0:
                self.enter[s] = clock
                clock += 1
            if k < len(children[s]):
                stack.append((s, k + 1))
                stack.append((children[s][k], 0))
            else:
                self.leave[s] = clock
        cuts: dict[str, list[tuple[int, int, int]]] = {}
        for s in range(1, len(parent)):
            cuts.setdefault(removed[s], []).append((self.enter[s], self.leave[s], born[s]))
        self.cuts = {x: tuple(zip(*sorted(c), strict=True)) for x, c in cuts.items()}

    def has_arc(self, s: int, x: str) -> bool:
        """Whether state ``s`` has an arc labelled ``x``.

        A merged label's arc exists if it was not removed since its merge and if, when it was merged,
        the state had the arc of the merge's left part.
        """
        before, label, at = len(self.enter) + len(self.left) + 1, x, self.enter[s]
        while True:
            cut = self.cuts.get(label)
            if cut is not None:
                k = bisect_right(cut[0], at) - 1
                if k >= 0 and at < cut[1][k] and cut[2][k] <= before:
                    return False
            step = self.left.get(label)
            if step is None:
                return True
            label, before = step

    def _tree(self) -> dict:
        """Labels by their symbols from the last to the first: a symbol's (symbols before it, the label that begins there or None)."""
        root: dict = {}
        for label in sorted(self.state, key=len):
            symbols = list(label)
            if label.endswith(SUFFIX) and len(label) > len(SUFFIX):
                symbols = list(label[: -len(SUFFIX) - 1]) + [label[-len(SUFFIX) - 1 :]]
            node = root
            for x in symbols[:0:-1]:
                node = node.setdefault(x, ({}, None))[0]
            node[symbols[0]] = (node.get(symbols[0], ({},))[0], label)
        return root

    def _row(self, s: int) -> dict:
        """State ``s``'s row of the transition table: the next state's row by label, None where there is no arc."""
        row = self.table.get(s)
        if row is None:
            row = self.table[s] = {STATE: s}
        return row

    def _arc(self, row: dict, x: str) -> dict | None:
        to = row[x] = self._row(self.state[x]) if self.has_arc(row[STATE], x) else None
        return to

    def path(self, symbols: list[str]) -> list[str]:
        """Labels of the one path that spells ``symbols`` (each a base symbol, the last with its suffix)."""
        tree, rows, labels, begins = self.tree, [self._row(0)], [""], [0]
        for end in range(len(symbols)):
            node, at = tree, end
            while True:
                got = node.get(symbols[at])
                if got is None:
                    raise ValueError("a symbol is missing from the vocabulary")
                node, x = got
                if x is not None:
                    row = rows[at]
                    to = row[x] if x in row else self._arc(row, x)
                    if to is not None:
                        break
                at -= 1
                if at < 0:
                    raise ValueError("a symbol is missing from the vocabulary")
            rows.append(to)
            labels.append(x)
            begins.append(at)
        out, at = [], len(symbols)
        while at:
            out.append(labels[at])
            at = begins[at]
        out.reverse()
        return out


class Words(dict):
    """A bounded cache of (number of tokens, ids, labels) by word."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> tuple[int, str, str]:
        got = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got


class WordTokenizer:
    """What a tokenizer file with word ends says: normalisation, pre-split, automaton, special tokens."""

    def __init__(self, spec: dict, cache: int = 300_000):
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: x for x, i in self.ids.items()} | {i: x for x, i in self.special.items()}
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.word, self.ascii = regex.compile(WORD_PATTERN), re.compile(ASCII_PATTERN)
        self.bytes = byte_alphabet()
        self.spec, self.library = spec, None
        self.assigned: set[str] = set()
        self.cache = Words(self._of_word, cache)

    def labels(self, word: str) -> list[str]:
        symbols = [*map(self.bytes.__getitem__, word.encode())]
        symbols[-1] += SUFFIX
        return self.automaton.path(symbols)

    def _of_word(self, word: str) -> tuple[int, str, str]:
        labels = self.labels(word)
        return len(labels), " ".join([str(self.ids[x]) for x in labels]), " ".join(labels)

    def words(self, segment: str) -> list[str]:
        if segment.isascii():
            return self.ascii.findall(segment.lower())
        new = set(segment) - self.assigned
        if new:
            self.assigned |= {c for c in new if unicodedata.category(c) != "Cn"}
            if not new <= self.assigned:
                return self._split_by_library(segment)
        # lower-casing goes character by character: no final sigma
        return self.word.findall(unicodedata.normalize("NFC", segment).replace("Σ", "σ").lower())

    def _split_by_library(self, segment: str) -> list[str]:
        """Unicode tables differ on characters that Python's has not yet assigned: the library pre-splits such a segment."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(json.dumps(self.spec))
            self.back = {c: b for b, c in self.bytes.items()}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(segment))
        return [bytes(self.back[c] for c in w).decode() for w, _ in found]

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, labels joined by a space) of each word or special token."""
        if not any(x in text for x in self.special):
            return self._known(text)
        at, out = 0, []
        for m in self.split.finditer(text):
            out += self._known(text[at : m.start()])
            out.append((1, str(self.special[m[0]]), m[0]))
            at = m.end()
        return out + self._known(text[at:])

    def _known(self, segment: str) -> list[tuple[int, str, str]]:
        return list(map(self.cache.__getitem__, self.words(segment)))

    def encoded(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, all ids, all labels) of a text."""
        got = self.pieces(text)
        if not got:
            return 0, "", ""
        counts, ids, labels = zip(*got, strict=True)
        return sum(counts), " ".join(ids), " ".join(labels)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text or "") for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Arc labels in order; without a decoder in the file they are joined by one space."""
        return " ".join(self.by_id[i] for i in ids)


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


ENCODED = "doc_id long, n_tokens long, ids string, decoded string"


def encode(docs: DataFrame, spec: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; one row out for each row in, no shuffle.

    ``spec``: a parsed tokenizer file of the word-end kind. Returns ids in decimal joined by a space and
    the decoded text. A null or empty text has no tokens; a null id stays; repeated rows are each
    encoded; an empty table gives none; other columns are not read. The merges go to the executors once
    and are compiled there; a worker's word cache is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(json.dumps(spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None
        for batch in batches:
            tok = tok or WordTokenizer(json.loads(shared.value))
            texts = batch.column(1)
            for lo in range(0, len(texts), 256):
                counts, ids, decoded = [], [], []
                for text in texts.slice(lo, 256).to_pylist():
                    n, i, d = tok.encoded(text or "")
                    counts.append(n)
                    ids.append(i)
                    decoded.append(d)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)
