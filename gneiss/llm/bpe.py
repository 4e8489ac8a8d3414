"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if every pair of
neighbours would stay apart when merged on its own. So the merges compile to a
nondeterministic transducer: a hypothesis is the last finished token and a place
in the trie of tokens; reading a byte walks the trie, and a token may be
finished there if it can follow the last one. Sets of hypotheses are
determinised as texts need them. A transition tells the token that is finished at
its byte; each hypothesis is a chain of such tokens, and the tokens that all chains
share are emitted. No token needs more lookahead than the longest token has bytes,
so that a piece of any length takes bounded memory beside its ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import kept, pieces, table


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by id, from the lines of a rank file; ids have no gap."""
    pairs = [line.split() for line in data.splitlines() if line]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


#: Bytes after which the settled tokens of a long piece are emitted; several times
#: the longest token, so that there are always some.
LOOKAHEAD = 4096
#: The longest pieces, in bytes, that the machine takes many of in step.
WIDE = 96
#: New moves that are kept as a dictionary before they join the arrays.
NEW = 20_000


class Transducer:
    """Encodes byte strings; keeps at most ``most`` determinised transitions.
    Vocabularies have less than 2^20 tokens."""

    def __init__(self, tokens: list[bytes], most: int = 400_000):
        self.tokens, self.most = tokens, most
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.sizes = list(map(len, tokens))
        self.packed = np.arange(len(tokens), dtype=np.int32).tobytes()
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.depth: list[int] = [0]
        for i, token in enumerate(tokens):
            at = 0
            for b in token:
                to = self.next[at].get(b)
                if to is None:
                    to = self.next[at][b] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.depth.append(self.depth[at] + 1)
                at = to
            self.ends[at] = i
        self.parts: dict[int, tuple[int, int]] = {}
        self.apart: dict[int, bool] = {}  # by (left << 20) | right
        self._forget()

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if len(self.tokens[token]) == 1:
            return None
        got = self.parts.get(token)
        if got is None:
            seq = [self.ids[bytes([b])] for b in self.tokens[token]]
            while len(seq) > 2:
                rank, k = min((self.ids.get(self.tokens[a] + self.tokens[b], len(self.tokens)), k) for k, (a, b) in enumerate(zip(seq, seq[1:])))
                if rank == len(self.tokens):
                    raise ValueError(f"token {token} can't be reached by merges")
                seq[k : k + 2] = [rank]
            got = self.parts[token] = tuple(seq)
        return got

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border, from the last merge backwards."""
        a, b, before = left, right, len(self.tokens)
        while True:
            crossing = self.ids.get(self.tokens[a] + self.tokens[b])
            if crossing is not None and crossing < before:
                ok = False
                break
            pa, pb = self.split(a), self.split(b)
            if pa is None and pb is None:
                ok = True
                break
            # Undo the later of the two merges; of equal ones the left came first.
            if pa is not None and (pb is None or a > b):
                before, a = a, pa[1]
            else:
                before, b = b + 1, pb[0]
        if len(self.apart) > self.most:
            self.apart.clear()
        self.apart[(left << 20) | right] = ok
        return ok

    def step(self, state: bytes, byte: int) -> tuple[bytes, int]:
        """Next state, and the token that is finished at this byte, or -1: every
        prefix has one encoding at most, so there is one such token at most. A
        state is an array of hypotheses, (last token + 1) << 32 | place in the trie."""
        now, finished, children, ends, apart = array("q"), -1, self.next, self.ends, self.apart
        for hypothesis in array("q", state):
            to = children[hypothesis & 0xFFFFFFFF].get(byte)
            if to is None:
                continue
            last = hypothesis >> 32
            if children[to]:
                now.append(last << 32 | to)
            if finished < 0:
                token = ends[to]
                if token >= 0:
                    if not last:
                        finished = token
                    else:
                        ok = apart.get((last - 1) << 20 | token)
                        if ok is None:
                            ok = self.stay_apart(last - 1, token)
                        if ok:
                            finished = token
        if finished >= 0:
            now.append((finished + 1) << 32)
        return now.tobytes(), finished

    def _forget(self) -> None:
        """Starts the determinised machine anew; state 0 is the initial one. Moves
        are numbers by state * 256 + byte: the next state, 24 bits, and over those
        the finished token + 1. The new ones are a dictionary, the others arrays."""
        self.states: list[bytes] = [array("q", [0]).tobytes()]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, int] = {}
        self.keys = self.values = np.empty(0, np.int64)

    def made(self) -> int:
        return len(self.moves) + len(self.keys)

    def _number(self, state: bytes) -> int:
        at = self.numbers.get(state)
        if at is None:
            at = self.numbers[state] = len(self.states)
            self.states.append(state)
        return at

    def _settle_moves(self) -> None:
        """The new moves join the arrays."""
        keys, values = (np.fromiter(x, np.int64, len(self.moves)) for x in (self.moves.keys(), self.moves.values()))
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], np.concatenate([self.values, values])[order]
        self.moves = {}

    def _move(self, at: int, byte: int, forget: bool = True) -> int:
        """A move that is not among the new ones."""
        key = at << 8 | byte
        if len(self.keys):
            i = int(np.searchsorted(self.keys, key))
            if i < len(self.keys) and self.keys[i] == key:
                return int(self.values[i])
        state = self.states[at]
        if forget and self.made() >= self.most:  # in the midst of a piece too, however long it is
            self._forget()
            at = self._number(state)
        state, finished = self.step(state, byte)
        if not state:
            raise ValueError("bytes that no tokens cover")
        move = self.moves[at << 8 | byte] = self._number(state) | (finished + 1) << 24
        return move

    def _path(self, finished: list[int], place: int) -> list[int]:
        """The tokens that end at a place, the last first."""
        out, size = [], self.sizes
        while place:
            token = finished[place - 1]
            out.append(token)
            place -= size[token]
        return out

    def _settled(self, finished: list[int], state: bytes) -> list[int]:
        """The tokens that all hypotheses share, the first first. Each hypothesis
        began where its last token ended, as many bytes ago as its node is deep."""
        paths = [self._path(finished, len(finished) - self.depth[h & 0xFFFFFFFF])[::-1] for h in array("q", state)]
        out = []
        for tokens in zip(*paths):
            if tokens.count(tokens[0]) < len(tokens):
                break
            out.append(tokens[0])
        return out

    def encode(self, data: bytes) -> tuple[int, ...]:
        if not data:
            return ()
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        if len(self.moves) > NEW:
            self._settle_moves()
        move, moves, finished, out = 0, self.moves, [], []
        for lo in range(0, len(data), LOOKAHEAD):
            for b in data[lo : lo + LOOKAHEAD] if lo or len(data) > LOOKAHEAD else data:
                at = (move & 0xFFFFFF) << 8 | b
                if at in moves:
                    move = moves[at]
                else:
                    move = self._move(at >> 8, b)
                    moves = self.moves
                finished.append((move >> 24) - 1)
            if lo + LOOKAHEAD < len(data):
                tokens = self._settled(finished, self.states[move & 0xFFFFFF])
                out += tokens
                del finished[: sum(map(self.sizes.__getitem__, tokens))]
        if finished[-1] < 0:
            raise ValueError("bytes that no tokens cover")
        path = self._path(finished, len(finished))
        path.reverse()
        return (*out, *path) if out else tuple(path)


    def encode_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The same for many pieces."""
        return [tuple(array("i", b)) for b in self.pack_many(pieces)]

    def _pack(self, data: bytes) -> bytes:
        return array("i", self.encode(data)).tobytes()

    def pack_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pieces, each's as the bytes of int32: the machine takes a byte
        of all of them at a time, and the moves that many need are looked up once."""
        ids, packed = self.ids.get, self.packed
        out = [packed[4 * i : 4 * i + 4] if (i := ids(p)) is not None else None for p in pieces]
        todo = []
        for k, p in enumerate(pieces):
            if out[k] is None:
                if 0 < len(p) <= WIDE:
                    todo.append(k)
                else:
                    out[k] = self._pack(p)
        if not todo:
            return out
        if self.made() >= self.most:
            self._forget()
        todo.sort(key=lambda k: -len(pieces[k]))
        size = np.array([len(pieces[k]) for k in todo])
        n, m = len(todo), int(size[0])
        grid = np.ascontiguousarray(np.frombuffer(b"".join(pieces[k].ljust(m, b"\0") for k in todo), np.uint8).reshape(n, m).T)
        state, finished = np.zeros(n, np.int64), np.empty((m, n), np.int32)
        for j in range(m):
            c = int(np.searchsorted(-size, -j, "left"))  # those that have this byte
            need, which = np.unique(state[:c] << 8 | grid[j, :c], return_inverse=True)
            move = self._look(need)[which]
            state[:c], finished[j, :c] = move & 0xFFFFFF, (move >> 24) - 1
            if self.made() > 4 * self.most:  # texts made to need them: one by one
                for k in todo:
                    out[k] = self._pack(pieces[k])
                return out
        # Back from the ends, a token of every piece at a time.
        place, live, steps, width = size.copy(), np.arange(n), [], np.array(self.sizes)
        while len(live):
            token = finished[place[live] - 1, live]
            if (token < 0).any():
                raise ValueError("bytes that no tokens cover")
            steps.append((live, token))
            place[live] -= width[token]
            live = live[place[live] > 0]
        count = np.zeros(n, np.int64)
        for live, _ in steps:
            count[live] += 1
        end = np.cumsum(count)
        flat = np.empty(int(end[-1]), np.int32)
        for s, (live, token) in enumerate(steps):
            flat[end[live] - 1 - s] = token
        flat, end = flat.tobytes(), (4 * end).tolist()
        for k, lo, hi in zip(todo, [0, *end], end):
            out[k] = flat[lo:hi]
        if len(self.moves) > NEW:
            self._settle_moves()
        return out

    def _look(self, need: np.ndarray) -> np.ndarray:
        """The moves of sorted keys; new ones are made."""
        at = np.minimum(np.searchsorted(self.keys, need), max(0, len(self.keys) - 1))
        known = self.keys[at] == need if len(self.keys) else np.zeros(len(need), bool)
        out = self.values[at] if len(self.keys) else np.zeros(len(need), np.int64)
        for i in np.flatnonzero(~known).tolist():
            key = int(need[i])
            move = self.moves.get(key)
            out[i] = self._move(key >> 8, key & 255, False) if move is None else move
        return out


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """UTF-8 as a state machine: bytes still due, and the bounds of the next."""
    due, low, high = state
    if due:
        return (due - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return START
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


START = (0, 0x80, 0xBF)


class StreamDecoder:
    """Ids in, text out; what is no whole character yet waits for the next ids.
    Malformed bytes become U+FFFD."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.state, self.waiting = tokens, START, b""
        self.moves: dict[tuple, tuple | None] = {}
        self.split = frozenset(i for i, t in enumerate(tokens) if self._walk(START, t) != START)

    @staticmethod
    def _walk(state, data: bytes):
        for b in data:
            state = utf8_step(state, b)
            if state is None:
                return None
            state = START if state[0] == 0 else state
        return state

    def feed(self, ids) -> bytes:
        """The whole characters that are ready, as UTF-8."""
        data = b"".join(map(self.tokens.__getitem__, ids))
        if not self.waiting and data.isascii():  # no byte leaves the start state
            return data
        if not self.waiting and self.split.isdisjoint(ids):
            return data
        state, broken = self.state, False
        for i in ids:
            key = (state, i)
            if key not in self.moves:
                self.moves[key] = self._walk(state, self.tokens[i])
            state = self.moves[key]
            if state is None:
                broken = True
                break
        data = self.waiting + data
        if broken:
            text = data.decode("utf-8", "replace")
            self.state, self.waiting = START, b""
            return text.encode()
        tail = 0
        if state != START:
            while tail < 3 and data[-1 - tail] & 0xC0 == 0x80:
                tail += 1
            tail += 1
        self.state, self.waiting = state, data[len(data) - tail :]
        return data[: len(data) - tail]

    def end(self) -> bytes:
        left = self.waiting.decode("utf-8", "replace").encode()
        self.state, self.waiting = START, b""
        return left


#: Fixed value: the pattern whose matches begin at a space between two non-spaces.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Coder:
    """Texts to ids and back. ``pattern`` cuts a text; each match is encoded on
    its own. With the pattern ``SPACED`` texts are cut at spaces between two
    non-spaces first, and what stands between them is a piece. Memory is bounded
    by twice ``most`` remembered pieces and matches of up to 64 characters, and what
    one call adds: when ``most`` are held, they become the old ones; what is asked
    for again comes back. A match of the pattern ``SPACED`` is its only match in
    itself, so that pieces and matches are remembered together. Ids are bytes of
    int32."""

    def __init__(self, tokens: list[bytes], pattern: str, most: int = 160_000):
        import re

        import regex

        self.tokens = tokens
        self.fst = Transducer(tokens)
        self.find = regex.compile(pattern).findall
        self.most = most
        self.known: dict[str, bytes] = {}  # by piece or match, a space before spaced ones
        self.old: dict[str, bytes] = {}
        self.blurred = re.compile(r" [\s\x85\xa0]| \Z" if pattern == SPACED else "").search

    def _cut(self, piece: str) -> list[str]:
        """The matches of a piece, led by a space or not. Letters with marks after
        them are two, and a line end between two other characters is one of its
        own; what else there is the pattern cuts."""
        bare = piece[1:] if piece[:1] == " " else piece
        if max(bare, default="\u0250") < "\u0250":  # letters that no version of Unicode disputes
            word = bare.rstrip(_MARKS)
            if word.isalpha():
                at = len(piece) - len(bare) + len(word)
                return [piece] if at == len(piece) else [piece[:at], piece[at:]]
        line, end, rest = bare.partition("\n")
        if line and rest and not line[-1].isspace() and not rest[0].isspace():
            return [*self._cut(piece[: len(piece) - len(bare)] + line), end, *self._cut(rest)]
        return self.find(piece)

    def _remember(self, texts: list[str], ids: list[bytes]) -> None:
        if len(self.known) >= self.most:
            self.old, self.known = self.known, {}
        self.known.update((t, i) for t, i in zip(texts, ids) if len(t) <= 64)

    def _find(self, texts: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is remembered of each, and the places of the others."""
        known, old = self.known.get, self.old.get
        out = [known(t) for t in texts]
        new, back = [], []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            ids = out[k] = old(texts[k])
            (new if ids is None else back).append(k)
        self.known.update((texts[k], out[k]) for k in back)
        return out, new

    def _of(self, matches: list[str]) -> list[bytes]:
        """Ids of each of the matches, which are different."""
        out, new = self._find(matches)
        texts = [matches[k] for k in new]
        found = self.fst.pack_many([t.encode() for t in texts])
        for k, ids in zip(new, found):
            out[k] = ids
        self._remember(texts, found)
        return out

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, which are led by a space or not."""
        out = []
        for at in range(0, len(pieces), 40_000):
            some = pieces[at : at + 40_000]
            got, new = self._find(some)
            cut = [self._cut(some[k]) for k in new]
            matches = list(dict.fromkeys(chain.from_iterable(cut)))
            ids = dict(zip(matches, self._of(matches)))
            more = []
            for k, c in zip(new, cut):
                if len(c) == 1:
                    got[k] = ids[c[0]]
                else:
                    got[k] = b"".join(map(ids.__getitem__, c))
                    more.append(k)
            self._remember([some[k] for k in more], [got[k] for k in more])
            out += got
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; each piece that they hold is taken once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if text and self.blurred(text):
                out[k] = np.frombuffer(self.pieces_of_matches(text), np.int32)
            elif text:
                plain.append(k)
        if not plain:
            return out
        lists = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
        begin = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        index, words = np.array(coded.indices, np.int32), coded.dictionary.to_pylist()
        # A text's first piece has no space before it.
        index[begin[:-1]] = len(words) + np.arange(len(plain))
        ids = self.pieces([" " + w for w in words] + [words[i] for i in coded.indices.take(pa.array(begin[:-1])).to_pylist()])
        del lists, coded, words
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        start, own = np.cumsum(size, dtype=np.int64) - size, size[index]
        upto = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        place = np.repeat(start[index] - upto[:-1], own)
        place += np.arange(upto[-1])
        every = flat[place]
        for k, lo, hi in zip(plain, upto[begin[:-1]].tolist(), upto[begin[1:]].tolist()):
            out[k] = every[lo:hi]
        return out

    def pieces_of_matches(self, text: str) -> bytes:
        """The ids of a text that only the pattern can cut, match by match."""
        found = self.find(text)
        different = list(dict.fromkeys(found))
        ids = dict(zip(different, self._of(different)))
        return b"".join(map(ids.__getitem__, found))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


def coder_of(ranks: bytes, pattern: str) -> tuple[Coder, StreamDecoder, list[str]]:
    """The worker's coder, decoder and decimal ids: what one task has compiled
    serves the next."""

    def make():
        tokens = read_ranks(ranks)
        return Coder(tokens, pattern), StreamDecoder(tokens), [str(i) for i in range(len(tokens))]

    return kept(hashlib.sha256(ranks + pattern.encode()).hexdigest(), make)


def tokenize(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array
    of int), one row per row.

    A null or empty text has no ids; repeated rows are rows of their own; texts
    are read whole, whatever their length. The digests are of the decimal ids
    joined by one space and of the decoded bytes. Rank files are small and of
    fixed size; one travels to each executor.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        for part, _, _ in pieces(batches, "text", 2 << 20):
            coder, decoder, names = coder_of(sent.value, pattern)
            doc, texts = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "text"))
            found = coder.encode_all([t or "" for t in texts.to_pylist()])
            hashes, back = [], []
            for ids in found:
                ids = ids.tolist()
                hashes.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                digest = hashlib.sha256(decoder.feed(ids))
                digest.update(decoder.end())
                back.append(digest.hexdigest())
            n = np.array([len(ids) for ids in found], np.int64)
            out = {"doc_id": doc, "n_tokens": pa.array(n), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
            del found, out
            pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op9_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    out = tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
