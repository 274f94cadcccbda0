"""BPE encoding and decoding with a tokenization automaton.

The automaton reads token sequences and accepts exactly those that BPE makes of
some byte string. It begins as one state with an arc for each of the 256 bytes.
Merges are compiled in order of rank; the gadget of a merge (u, v) -> w

* copies the state that u's arcs lead to, without the arc v, and points u's
  arcs at the copy: u before v would have been merged;
* adds an arc w, to where v led, at every state that has an arc u.

All arcs with the same label lead to the same state. A state is kept as the token
and the rank of the gadget that made it, and its arcs follow from the gadgets.

Words are encoded from left to right by the transitions of two tables. Every
beginning of a word has one accepted reading, so after each byte one arc can be
the last: it ends here and is at the state reached where it set out. The first table,
(node, byte) -> node, reads bytes and gives the tokens that end here, longest first; the
second, (state, arc), tells which of them the automaton has at its state. Nothing is
tried twice, tokens are read back from the end of the word, and the time is in
proportion to its length. Rows of the second table and the jumps of the first are made
when a word first needs them, as all of them are far more than texts use, and are
kept up to a bound. The distinct words of a block of texts are read side by side, one
byte of all of them at a time, in numpy; only a very long word is read alone. Decoding emits the arc labels, which are byte strings, and reads
the whole as UTF-8 with replacement characters.

The vocabulary file is read on the driver and broadcast: its size is that of the
vocabulary, whatever the input. Each worker compiles it once.

Defined results: a null text counts as empty and has no tokens. The text of a
special token becomes that token, as in the tokenizers library. Repeated rows
are encoded one by one; an empty table gives an empty result; texts are encoded
whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, release_memory, released, table

#: Fixed: how byte-level BPE pre-splits a text.
WORDS = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for Latin-1 texts without the bytes in ``ODD``, whose classes differ between the two libraries; the standard library's is faster.
LATIN_WORDS = r" ?[^\W\d_]++| ?\d++|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+"
ODD = "²³¹¼½¾\x1c\x1d\x1e\x1f".encode("latin-1")
#: Arcs and jumps that a worker keeps at once for words that are read alone.
KEPT_ARCS = 100_000
KEPT_JUMPS = 100_000
#: Slots of the table of arcs for words that are read side by side; a power of two.
ARC_SLOTS = 1 << 18
#: Words up to this length are read side by side, so many at once, and so many times the length of the longest.
SHORT_WORD = 64
WORDS_AT_ONCE = 30_000
CELLS_AT_ONCE = 500_000
BLOCK_BYTES = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys * np.int64(0x1E3779B97F4A7C15) >> 40) & (ARC_SLOTS - 1)


class Automaton:
    """Tokens are ids; ``labels[id]`` is the byte string of an arc."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.vocab = vocab
        self.special = special or {}
        self.labels = dict(zip(vocab.values(), vocab.keys(), strict=True)) | {i: s.encode() for s, i in self.special.items()}
        n = max(self.labels, default=0) + 1
        #: By token: the parts of its merge and that merge's rank; a byte has rank -1.
        self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1] * n
        #: state -> (token, rank): the token that led to it and the gadget that made it. State 0 has all bytes.
        self.states: list[tuple[int, float]] = [(-1, -1)]
        #: By token: the state its arcs lead to.
        self.target = [0] * n
        #: u << 20 | v -> rank of the gadget that took arc v from the state after u.
        self.taken: dict[int, int] = {}
        #: Tokens that no reading has: their parts never meet.
        self.unread: set[int] = set()
        for rank, (x, y) in enumerate(merges):
            self._gadget(rank, vocab[x], vocab[y], vocab[x + y])
        if self.unread:
            vocab = self.vocab = {label: t for label, t in vocab.items() if t not in self.unread}
        #: The labels as a trie: node << 8 | byte -> node. The node of a label is its token, the others have higher numbers.
        self.step: dict[int, int] = {}
        self.root = inner = n
        for label in sorted(vocab):
            node = self.root
            for i, byte in enumerate(label, 1):
                key = node << 8 | byte
                if key not in self.step:
                    inner += (token := vocab.get(label[:i])) is None
                    self.step[key] = inner if token is None else token
                node = self.step[key]
        self.sizes = [len(self.labels.get(i, b"")) for i in range(n)]
        #: By node: the node of the longest shorter end of what it has read, and the longest token that is an end of it.
        self.back = [self.root] * (inner + 1)
        self.ending = [node if node < n else -1 for node in range(inner + 1)]
        self._link()
        #: Jumps: (node << 8 | byte) -> node where the trie has no step.
        self.jumps: dict[int, int] = {}
        #: state << 20 | token -> whether the state has that arc.
        self.arcs: dict[int, bool] = {}
        self._as_arrays()

    def _link(self) -> None:
        """Fills ``back`` and ``ending``, node by node from the root."""
        after: dict[int, list[int]] = {}
        for key in self.step:
            after.setdefault(key >> 8, []).append(key)
        waiting = [self.root]
        for node in waiting:
            for key in after.pop(node, ()):
                child, byte = self.step[key], key & 255
                waiting.append(child)
                if node != self.root:
                    shorter = self.back[node]
                    while (found := self.step.get(shorter << 8 | byte)) is None and shorter != self.root:
                        shorter = self.back[shorter]
                    self.back[child] = self.root if found is None else found
                if child >= self.root:
                    self.ending[child] = self.ending[self.back[child]]

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if self.rank[w] >= 0 or u in self.unread or v in self.unread or not self._arc_at(self.target[u], v):
            if self.rank[w] < 0:  # v never follows u, so that w is in no reading
                self.unread.add(w)
            return
        after_v = self.target[v]
        self.states.append((u, rank))
        self.target[u] = len(self.states) - 1
        self.target[w] = after_v
        self.taken[u << 20 | v] = rank
        self.left[w], self.right[w], self.rank[w] = u, v, rank

    def _arc_at(self, state: int, arc: int) -> bool:
        """Whether a state has an arc with this label.

        Gadgets are undone from the last one: the arc that was at the state before is
        the left part, and the state is that after the right part. The arc is missing
        if a gadget took it while both were as they are at that point.
        """
        left, right, rank, taken = self.left, self.right, self.rank, self.taken
        token, made = self.states[state]
        before = made + 0.1
        while token >= 0:
            at = taken.get(token << 20 | arc)
            if at is not None and at < before:
                return False
            if rank[token] > rank[arc]:
                before, token = rank[token], right[token]
            elif rank[arc] >= 0:  # of equal merges side by side the first is made
                before, arc = min(before, rank[arc] + 0.5), left[arc]
            else:
                return True
        return True

    def _jump(self, node: int, byte: int) -> int:
        """Makes a transition of the first table."""
        key, step = node << 8 | byte, self.step
        while (found := step.get(node << 8 | byte)) is None:
            if node == self.root:
                raise ValueError(f"no reading: the vocabulary lacks the byte {byte}")
            node = self.back[node]
        if len(self.jumps) >= KEPT_JUMPS:
            self.jumps.clear()
        self.jumps[key] = found
        return found

    def _arc(self, key: int) -> bool:
        """Makes an entry of the second table."""
        if len(self.arcs) >= KEPT_ARCS:
            self.arcs.clear()
        found = self.arcs[key] = self._arc_at(key >> 20, key & (1 << 20) - 1)
        return found

    def encode(self, word: bytes) -> list[int]:
        """The labels of the accepted reading of a word."""
        step, jumps, arcs, ending, back, sizes, target = self.step.get, self.jumps.get, self.arcs.get, self.ending, self.back, self.sizes, self.target
        node, ends, states = self.root, [], [0]
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            found = step(key)
            if found is None and (found := jumps(key)) is None:
                found = self._jump(node, byte)
            node = found
            token = ending[node]
            while token >= 0:
                key = states[end - sizes[token]] << 20 | token
                known = arcs(key)
                if known or known is None and self._arc(key):
                    break
                token = ending[back[token]]
            else:
                raise ValueError(f"no reading: the vocabulary lacks the byte {byte}")
            ends.append(token)
            states.append(target[token])
        end, path = len(word), []
        while end:
            token = ends[end - 1]
            path.append(token)
            end -= sizes[token]
        path.reverse()
        return path

    def _as_arrays(self) -> None:
        keys = np.fromiter(self.step.keys(), dtype=np.int64, count=len(self.step))
        order = np.argsort(keys)
        self._step_keys = keys[order]
        self._step_nodes = np.fromiter(self.step.values(), dtype=np.int32, count=len(self.step))[order]
        self._back, self._ending, self._target, self._sizes = (np.array(x, dtype=np.int32) for x in (self.back, self.ending, self.target, self.sizes))
        self._slot_keys, self._slot_known = np.full(ARC_SLOTS, -1, dtype=np.int64), np.zeros(ARC_SLOTS, dtype=bool)

    def _steps(self, nodes: np.ndarray, read: np.ndarray) -> np.ndarray:
        """The first table, for many nodes and bytes."""
        found = np.empty(len(nodes), dtype=np.int32)
        left = np.arange(len(nodes))
        while len(left):
            keys = nodes.astype(np.int64) << 8 | read
            at = np.minimum(np.searchsorted(self._step_keys, keys), len(self._step_keys) - 1)
            hit = self._step_keys[at] == keys
            found[left[hit]] = self._step_nodes[at[hit]]
            left, nodes, read = left[~hit], nodes[~hit], read[~hit]
            if (nodes == self.root).any():
                raise ValueError(f"no reading: the vocabulary lacks the byte {read[nodes == self.root][0]}")
            nodes = self._back[nodes]
        return found

    def _have(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The second table, for many states and tokens. An entry is made anew if another one took its slot."""
        keys = states.astype(np.int64) << 20 | tokens
        slots = _slots(keys)
        have, new = self._slot_known[slots], np.flatnonzero(self._slot_keys[slots] != keys)
        if len(new):
            wanted, which = np.unique(keys[new], return_inverse=True)
            known = np.array([self._arc_at(k >> 20, k & (1 << 20) - 1) for k in wanted.tolist()], dtype=bool)
            have[new] = known[which]
            at = _slots(wanted)
            self._slot_keys[at] = wanted
            # of several entries for a slot the last one stays
            stays = self._slot_keys[at] == wanted
            self._slot_known[at[stays]] = known[stays]
        return have

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= SHORT_WORD]
        for i, word in enumerate(words):
            if len(word) > SHORT_WORD:
                out[i] = np.array(self.encode(word), dtype="<u4").tobytes()
        short.sort(key=lambda i: -len(words[i]))
        k = 0
        while k < len(short):
            some = short[k : k + min(WORDS_AT_ONCE, CELLS_AT_ONCE // len(words[short[k]]))]
            for i, ids in zip(some, self._side_by_side([words[i] for i in some]), strict=True):
                out[i] = ids
            k += len(some)
        return out

    def _side_by_side(self, words: list[bytes]) -> list[bytes]:
        """:meth:`encode` for words in falling order of length."""
        sizes = np.array([len(w) for w in words])
        n, longest = len(words), int(sizes[0])
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        nodes = np.full(n, self.root, dtype=np.int32)
        states, ends = np.zeros((longest + 1, n), dtype=np.int32), np.zeros((longest, n), dtype=np.int32)
        for k in range(longest):
            on = int(np.searchsorted(-sizes, -k))  # the words longer than k
            nodes[:on] = self._steps(nodes[:on], text[starts[:on] + k])
            tokens, left = self._ending[nodes[:on]], np.arange(on)
            while len(left):
                some = tokens[left]
                if (some < 0).any():
                    raise ValueError("no reading: the vocabulary lacks a byte")
                left = left[~self._have(states[k + 1 - self._sizes[some], left], some)]
                tokens[left] = self._ending[self._back[tokens[left]]]
            ends[k, :on], states[k + 1, :on] = tokens, self._target[tokens]
        # read back from the end: ids in reverse, one more of each word at a time
        path, counts = np.zeros((longest, n), dtype="<u4"), np.zeros(n, dtype=np.int64)
        at, left = sizes.copy(), np.arange(n)
        while len(left):
            tokens = ends[at[left] - 1, left]
            path[longest - 1 - counts[left], left] = tokens
            counts[left] += 1
            at[left] -= self._sizes[tokens]
            left = left[at[left] > 0]
        data, width = np.ascontiguousarray(path.T).tobytes(), 4 * longest
        return [data[(i + 1) * width - 4 * c : (i + 1) * width] for i, c in enumerate(counts.tolist())]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def compile_vocabulary(content: bytes) -> Automaton:
    """From a tokenizer file of the tokenizers library with a byte-level BPE model."""
    spec = json.loads(content)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}

    def plain(token: str) -> bytes:
        return bytes(letters[c] for c in token)

    vocab = {plain(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return Automaton(vocab, [(plain(a), plain(b)) for a, b in merges], special)


class Encoder:
    """Texts to ids, as little-endian 32-bit integers, and back."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.find_any = regex.compile(WORDS).findall
        self.find_latin = re.compile(LATIN_WORDS).findall
        special = sorted(automaton.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def find(self, text: str) -> list[str]:
        try:
            plain = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_any(text) if len(plain.translate(None, ODD)) < len(plain) else self.find_latin(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split: list[list[str]] = []  # special tokens stand at odd places
        for text in texts:
            if self.special is None or not any(s in text for s in self.automaton.special):
                split.append([text])
            else:
                split.append(self.special.split(text))
        own: dict[str, str] = {}  # a word is one string, however often it occurs

        def words_of(part: str) -> list[str]:
            words = self.find(part)
            return list(map(own.setdefault, words, words))

        found = [[[part] if i % 2 else words_of(part) for i, part in enumerate(parts)] for parts in split]
        known = dict(zip(own, self.automaton.encode_all([w.encode() for w in own]), strict=True))
        special = {s: i.to_bytes(4, "little") for s, i in self.automaton.special.items()}
        return [b"".join(b"".join(map((special if i % 2 else known).__getitem__, words)) for i, words in enumerate(parts)) for parts in found]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(memoryview(ids).cast("I").tolist())


#: Of this worker: digest of the vocabulary file -> encoder.
_ENCODERS: dict[str, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    key = hashlib.sha256(content).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(compile_vocabulary(content))
        release_memory()
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), and decoded: the text that the ids give back."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(shared.value)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                ids = model.encode_all(block.column(1).to_pylist())
                decoded = [model.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
        _ENCODERS.clear()  # workers live on after their task: its tables are not left to what comes next

    plain = docs.select("doc_id", "text")
    return plain.mapInArrow(released(run), f"doc_id {dict(plain.dtypes)['doc_id']}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    n = (F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents")))
