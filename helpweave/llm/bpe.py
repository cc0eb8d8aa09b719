"""Byte-level BPE: frequent words through a minimal acyclic transducer, all others by exact merging."""

from __future__ import annotations

import hashlib
import json
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpweave.llm.counts import frequent
from helpweave.llm.textnum import Words, chunks, lists
from helpweave.session import materialize

#: Pre-tokens of the vocabulary's byte-level scheme (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the lexicon; words longer than this many bytes never enter it.
LEXICON, LONGEST = 50_000, 48
#: Characters of text that one lexicon walk handles at a time.
STEP = 1 << 19
#: Merged words that a task remembers.
MEMO = 200_000


def byte_letters() -> dict[int, str]:
    """Letter of each byte in the vocabulary file: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class Vocabulary:
    """Merge ranks, token bytes and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda t: bytes(back[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): n for n, (a, b) in enumerate(pairs)}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

        self.first = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pair = np.array([(self.ids[a] << 32) | self.ids[b] for a, b in self.ranks], np.int64)
        order = np.argsort(pair)
        self.pair, self.pair_rank = pair[order], np.array([*self.ranks.values()], np.int64)[order]
        self.made = np.zeros(max([-1, *self.ranks.values()]) + 2, np.int64)
        for (a, b), n in self.ranks.items():
            self.made[n] = self.ids[a + b]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, ``len(made)`` where there is none (or an id is -1)."""
        if not len(self.pair):
            return np.full(left.shape, len(self.made))
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], len(self.made))

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` one after the other, and how many each has; one merge of every word a round."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        for i in np.flatnonzero((size > LONGEST) | (size < 2)).tolist():
            out[i] = np.array(self.merge(words[i]), np.int32)
        order = np.flatnonzero((size <= LONGEST) & (size >= 2))
        order = order[np.argsort(size[order], kind="stable")]
        for group in np.array_split(order, max(1, len(order) // 2000)):
            if not len(group):
                continue
            width = int(size[group].max())
            text = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in group), np.uint8).reshape(len(group), width)
            ids = np.where(np.arange(width) < size[group][:, None], self.first[text], -1)
            left = size[group].copy()
            rank = self.rank_of(ids[:, :-1], ids[:, 1:])
            live = np.arange(len(group))
            while True:
                at = rank[live].argmin(axis=1)
                low = rank[live, at]
                go = low < len(self.made)
                live, at, low = live[go], at[go], low[go]
                if not len(live):
                    break
                take = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
                mine = np.take_along_axis(np.c_[ids[live], np.full(len(live), -1)], take, 1)
                rows = np.arange(len(live))
                mine[rows, at] = self.made[low]
                near = np.take_along_axis(np.c_[rank[live], np.full(len(live), len(self.made))], take[:, :-1], 1)
                near[rows, np.minimum(at, width - 2)] = self.rank_of(mine[rows, np.minimum(at, width - 2)], mine[rows, np.minimum(at, width - 2) + 1])
                before = np.maximum(at - 1, 0)
                near[rows, before] = self.rank_of(mine[rows, before], mine[rows, before + 1])
                ids[live], rank[live] = mine, near
                left[live] -= 1
            flat = ids[ids >= 0].astype(np.int32)
            for i, part in zip(group.tolist(), np.split(flat, np.cumsum(left)[:-1])):
                out[i] = part
        count = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), count

    def merge(self, word: bytes) -> list[int]:
        """Apply the lowest-ranked merge, leftmost first, until none fits."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        if len(parts) > 256:
            return self._merge_long(parts)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ids[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same for very long words: a heap of pairs over a linked list."""
        import heapq

        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.ids[p] for p, ok in zip(parts, alive) if ok]


# --- lexicon ----------------------------------------------------------------------------
def compile_lexicon(words: list[bytes]) -> bytes:
    """Minimal acyclic automaton of sorted distinct ``words`` as one flat image.

    States with equal suffix languages are shared; a word's output is its rank among the words, which is
    the sum of the numbers on its path (words that leave a state earlier). The image holds a table of
    next states by state and byte class, the path numbers, and the accepting flags.
    """
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def fixed(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in [*words, None]:
        same = 0
        if word is not None:
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
        while len(path) > same + 1:  # close the states that no later word can reach
            done = fixed(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        if word is not None:
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
    root = fixed(path[0])
    below = np.zeros(len(states), np.int64)  # words that a state accepts; children come before parents
    for i, (final, arcs) in enumerate(states):
        below[i] = final + sum(below[t] for _, t in arcs)
    used = sorted({b for _, arcs in states for b, _ in arcs})
    classes = np.full(256, len(used), np.int32)
    classes[used] = np.arange(len(used))
    width, dead = len(used) + 1, len(states)
    step = np.full((dead + 1, width), dead, np.int32)
    add = np.zeros((dead + 1, width), np.int32)
    final = np.zeros(dead + 1, np.int32)
    for i, (end, arcs) in enumerate(states):
        final[i], seen = end, int(end)
        for b, t in arcs:
            step[i, classes[b]], add[i, classes[b]] = t, seen
            seen += below[t]
    head = np.array([dead + 1, width, root], np.int32)
    return b"".join(x.tobytes() for x in (head, classes, final, step, add))


class Lexicon:
    """The automaton, read through a memory map of an unlinked file, so that pages can be dropped and reread."""

    def __init__(self, image: bytes, ids: np.ndarray, counts: np.ndarray):
        self.file = tempfile.TemporaryFile()
        self.file.write(image)
        self.file.flush()
        view = np.frombuffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ), np.int32)
        n, self.width, self.root = (int(x) for x in view[:3])
        self.classes, view = view[3:259], view[259:]
        self.final, view = view[:n], view[n:]
        self.step, self.add = view[: n * self.width], view[n * self.width : 2 * n * self.width]
        self.dead, self.ids, self.counts = n - 1, ids, counts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Output number of each word, -1 for words outside; all words walk at once, one byte a step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.cumsum(size) - size
        text = self.classes[np.frombuffer(b"".join(words), np.uint8)]
        state, out = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live, depth = np.flatnonzero((size > 0) & (size <= LONGEST)), 0
        while len(live):
            arc = state[live] * self.width + text[at[live] + depth]
            out[live] += self.add[arc]
            state[live] = self.step[arc]
            depth += 1
            live = live[(size[live] > depth) & (state[live] != self.dead)]
        ok = (self.final[state] > 0) & (size <= LONGEST) & (size > 0)
        return np.where(ok, out, -1)


# --- Spark side ---------------------------------------------------------------------------
def _words(text: str, vocabulary: Vocabulary, pattern: regex.Pattern) -> list[str]:
    """Pre-tokens of a text; special strings stay whole and are of a type of their own."""
    if vocabulary.cut is None or not any(s in text for s in vocabulary.special):
        return pattern.findall(text)
    out: list[str] = []
    for part in vocabulary.cut.split(text):
        if part in vocabulary.special:
            out.append(_Special(part))
        else:
            out.extend(pattern.findall(part))
    return out


class _Special(str):
    """A special string, unequal to ordinary text that looks the same."""

    __slots__ = ()
    __hash__ = str.__hash__

    def __eq__(self, other):
        return isinstance(other, _Special) and str.__eq__(self, other)


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def count_words(texts: DataFrame, column: str = "text") -> DataFrame:
    """``word (binary), n``: runs of letters of all texts, with the space before them if there is one.

    Runs of at most ``LONGEST`` bytes are counted, summed per task before the shuffle. Any byte from 128 on counts as a letter here: these
    are candidates for the lexicon, whose entries are encoded like all other words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return made

        for b in batches:
            for _, _, data, bounds in chunks(b.column(0)):
                words = Words(data, bounds, blank=~LETTER)
                start, end = words.start, words.end
                spaced = np.zeros(len(start), bool)
                spaced[start > 0] = data[start[start > 0] - 1] == 32
                spaced[words.bounds[:-1][words.counts > 0]] &= start[words.bounds[:-1][words.counts > 0]] > bounds[:-1][words.counts > 0]
                key = words.hash ^ spaced.astype(np.uint64)
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                start = (start - spaced)[first]
                raw = data.tobytes()
                for x, y, n in zip(start.tolist(), end[first].tolist(), count.tolist()):
                    if y - x <= LONGEST:
                        w = raw[x:y]
                        seen[w] = seen.get(w, 0) + n
                if len(seen) > 200_000:
                    yield out()
        yield out()

    return texts.select(F.col(column).cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(counts: DataFrame, tokenizer: str, limit: int = LEXICON) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Automaton image, and the token ids of the (at most ``limit``) most frequent words with their numbers."""
    words = sorted(bytes(r["word"]) for r in frequent(counts, limit).select("word").collect())
    return compile_lexicon(words), *Vocabulary(tokenizer).merge_all(words)


def encode(texts: DataFrame, tokenizer: str, column: str = "text", into: str = "ids", limit: int = LEXICON) -> DataFrame:
    """All columns of ``texts`` but ``column``, and ``into``: token ids (array of int) of the whole text.

    Same ids as the tokenizer file gives without added special tokens; special strings inside a text get
    their own id. Null and empty texts have no tokens; rows are independent, so repeated rows and ties
    encode alike; any other columns pass through; an empty table stays empty.

    The word counts cover all texts; the lexicon made of them is bounded by ``limit`` words of
    ``LONGEST`` bytes whatever the input, and is broadcast. A word outside it is merged exactly.
    """
    counts = materialize(count_words(texts, column).where("n > 1"))
    shared = texts.sparkSession.sparkContext.broadcast(build_lexicon(counts, tokenizer, limit))
    rest = [f for f in texts.schema.fields if f.name not in (column, into)]
    given = texts.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{column}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, vocabulary = regex.compile(PATTERN), Vocabulary(tokenizer)
        lexicon = Lexicon(*shared.value)
        base, start = lexicon.ids, np.r_[0, np.cumsum(lexicon.counts)]
        flat, at, memo = base, start, {}

        def places(words: list[str]) -> np.ndarray:
            """Row of each word in the id table; new words are looked up, or merged and added."""
            nonlocal flat, at
            if len(memo) > MEMO:
                memo.clear()
                flat, at = base, start
            new = [w for w in set(words) if w not in memo]
            plain = [w for w in new if not isinstance(w, _Special)]
            raw = [w.encode() for w in plain]
            found = lexicon.find(raw)
            memo.update(zip(plain, found.tolist()))
            lost = np.flatnonzero(found < 0).tolist()
            ids, count = vocabulary.merge_all([raw[i] for i in lost])
            own = [w for w in new if isinstance(w, _Special)]
            memo.update(zip([plain[i] for i in lost] + own, range(len(at) - 1, len(at) - 1 + len(lost) + len(own))))
            count = np.r_[count, np.ones(len(own), np.int64)]
            flat = np.r_[flat, ids, np.array([vocabulary.special[str(w)] for w in own], np.int32)]
            at = np.r_[at, at[-1] + np.cumsum(count)]
            return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

        for b in batches:
            column_at, n = b.num_columns - 1, b.num_rows
            texts_, i = b.column(column_at).fill_null("").to_pylist(), 0
            while i < n:
                j, size = i, 0
                while j < n and (j == i or size + len(texts_[j]) <= STEP):
                    size += len(texts_[j])
                    j += 1
                words = [_words(t, vocabulary, pattern) for t in texts_[i:j]]
                row = places([w for ws in words for w in ws])
                size = at[row + 1] - at[row]
                stop = np.r_[0, np.cumsum(size)]
                ids = flat[np.arange(stop[-1]) + np.repeat(at[row] - stop[:-1], size)]
                ends = stop[np.cumsum([0, *map(len, words)])]
                made = lists(ids.astype(np.int32), np.diff(ends), pa.int32())
                names = [*b.schema.names[:-1], into]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(column_at)), made], names=names)
                i = j

    from pyspark.sql import types as T

    schema = T.StructType([*rest, T.StructField(into, T.ArrayType(T.IntegerType(), False))])
    return given.mapInArrow(run, schema)


#: Tokens of up to this many bytes are copied from a table of that width.
WIDE = 16


class Cells:
    """Byte strings by number, kept flat and, cut to ``WIDE`` bytes, as table rows."""

    def __init__(self, cells: list[bytes]):
        self.size = np.array([len(c) for c in cells], np.int64)
        self.flat, self.at = np.frombuffer(b"".join(cells), np.uint8), np.cumsum(self.size) - self.size
        self.rows = np.frombuffer(b"".join(c[:WIDE].ljust(WIDE, b"\0") for c in cells), np.uint8).reshape(len(cells), WIDE)

    def join(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The strings of each run of ids, one after the other."""
        size = self.size[ids]
        stop = np.cumsum(size)
        width = int(size.max()) if len(ids) else 0
        if width <= WIDE:
            raw = self.rows[ids, :width][np.arange(width) < size[:, None]].tobytes()
        else:
            raw = self.flat[np.arange(stop[-1]) + np.repeat(self.at[ids] - (stop - size), size)].tobytes()
        edges = np.r_[0, stop][bounds].tolist()
        return [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]


def token_cells(tokenizer: str) -> Cells:
    vocabulary = Vocabulary(tokenizer)
    return Cells([vocabulary.bytes.get(i, b"") for i in range(max(vocabulary.bytes) + 1)])


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0] : at[-1]].astype(np.int64), at - at[0]


def decode(encoded: DataFrame, tokenizer: str, column: str = "ids", into: str = "text", digests: bool = False, keep: bool = False) -> DataFrame:
    """All columns but ``column`` (unless ``keep``), and ``into``: the decoded text (special tokens kept, broken UTF-8 replaced).

    Null ids decode to an empty text. With ``digests`` the columns ``n_tokens, ids_sha256`` (of the decimal
    ids joined by commas) and ``decoded_sha256`` follow instead of the text.
    """
    made_names = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else (into,)
    rest = [f for f in encoded.schema.fields if f.name not in (column, *made_names)]
    given = encoded.select(*[F.col(f"`{f.name}`") for f in rest], F.coalesce(F.col(f"`{column}`"), F.array().cast("array<int>")).alias(column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_cells(tokenizer)
        decimal = Cells([b"%d," % i for i in range(len(table.size))]) if digests else None
        for b in batches:
            last = b.num_columns - 1
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                ids, bounds = _list_parts(part.column(last))
                texts = [x.decode("utf-8", "replace") for x in table.join(ids, bounds)]
                held = [part.column(k) for k in range(last + keep)]
                if digests:
                    made = [
                        pa.array(np.diff(bounds)),
                        pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in decimal.join(ids, bounds)], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    ]
                    names = [*part.schema.names[: last + keep], "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    made, names = [pa.array(texts, pa.string())], [*part.schema.names[: last + keep], into]
                yield pa.RecordBatch.from_arrays(held + made, names=names)

    from pyspark.sql import types as T

    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [(into, T.StringType())]
    own = [T.StructField(column, T.ArrayType(T.IntegerType()))] if keep else []
    return given.mapInArrow(run, T.StructType([*rest, *own, *[T.StructField(n, t) for n, t in new]]))


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
