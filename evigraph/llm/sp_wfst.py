"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The compiled machine is the composition of three parts:

* the *normaliser*: the model's compiled character map, if it has one (a double-array trie of byte strings, compiled to arcs that
  rewrite the longest match), optional dummy prefix, optional removal of extra white space, space to
  the meta symbol ``\\u2581``;
* the *lexicon*: one arc per piece that emits its id, plus for every character outside the vocabulary an arc that
  emits its bytes (byte fallback), or ``<unk>`` where the model has no byte pieces;
* for models trained by byte-pair merges, a *bigram acceptor* whose states are the last piece
  read: the arc from ``a`` to ``b`` weighs 0 when the merges keep ``a|b`` apart and infinity
  otherwise. A segmentation is the one that the merges give exactly when each neighbouring pair
  is, so one path of finite weight remains and the tropical shortest path is it.

For unigram models arcs weigh minus the piece's score and no bigram acceptor is composed. An input
is composed with the machine chunk by chunk: no piece crosses from another character to a meta
symbol, or from a letter to certain marks (those that follow a letter in no piece), so runs between
such places are independent, and the shortest path of a run is remembered (bounded memory).

Null text encodes as empty; repeated rows get equal ids; texts of any length go the same way. Decoding inverts encoding: bytes are gathered into UTF-8 (ill-formed
ones become U+FFFD), meta symbols become spaces and the dummy prefix goes; it equals the text
whenever the normaliser is lossless and the text holds no meta symbol itself.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS, over_texts

META = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Model files over this are refused: the file travels with every task.
MODEL_LIMIT = 64 << 20
#: Chunks remembered in one generation, and characters of a prefix whose state is remembered.
MEMORY, PREFIX = 400_000, 6
#: Pieces and characters are numbered below this; an arc of the bigram acceptor is one number.
ARC, ONE = 1 << 22, (1,)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    i = 0
    while i < len(b):
        n = s = 0
        while True:
            c = b[i]
            i += 1
            n |= (c & 127) << s
            s += 7
            if c < 128:
                break
        kind = n & 7
        if kind == 0:
            v = s = 0
            while True:
                c = b[i]
                i += 1
                v |= (c & 127) << s
                s += 7
                if c < 128:
                    break
            yield n >> 3, v
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield n >> 3, b[i : i + size]
            i += size
        elif kind == 2:
            size = s = 0
            while True:
                c = b[i]
                i += 1
                size |= (c & 127) << s
                s += 7
                if c < 128:
                    break
            yield n >> 3, b[i : i + size]
            i += size
        else:
            raise ValueError("not a SentencePiece model")


def _character_map(blob: bytes) -> dict[str, str]:
    """The rewrites of a compiled character map: a trie (32-bit units, its size before it) whose leaves point to NUL-ended strings."""
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    texts = blob[4 + size :]
    label, every = units & 0x800000FF, np.arange(1, 256)
    offset = (units >> 10) << ((units & 0x200) >> 6)
    out, open_ = {}, [(b"", int(offset[0]))]
    while open_:
        key, at = open_.pop()
        near = at ^ every
        inside = near < len(units)
        for c in every[inside][label[near[inside]] == every[inside]].tolist():
            unit = at ^ c
            below = unit ^ int(offset[unit])
            if units[unit] >> 8 & 1:
                v = int(units[below]) & 0x7FFFFFFF
                try:
                    out[(key + bytes([c])).decode()] = texts[v : texts.index(0, v)].decode()
                except UnicodeDecodeError:
                    pass  # inside a character
            open_.append((key + bytes([c]), below))
    return out


class _Memory(dict):
    """Shortest paths of the chunks met, in two generations: what is used again outlives one."""

    def __init__(self, path, most: int):
        super().__init__()
        self.path, self.most, self.old = path, most, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        got = self.old.get(chunk)
        if got is None:
            got = self.path(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = got
        return got


class Machine:
    """The compiled transducer of one model; ``memory`` bounds the chunks, arcs and prefixes that it remembers."""

    def __init__(self, model: bytes, memory: int = MEMORY):
        self.memory = memory
        self.pieces: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        self.dummy, self.squeeze, self.escape, self.bpe = True, True, True, False
        norm: dict = {}
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                self.score.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kind.append(p.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                self.bpe = trainer.get(3, 1) == 2
                if trainer.get(3, 1) not in (1, 2) or trainer.get(24, 0):
                    raise ValueError("only unigram and byte-pair models with leading meta symbols are supported")
            elif field == 3:
                norm |= dict(_fields(value))
        self.dummy, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.rewrites = _character_map(norm[2]) if norm.get(2) else {}
        #: The longest match that begins with a character.
        self.reach: dict[str, int] = {}
        for k in self.rewrites:
            self.reach[k[0]] = max(self.reach.get(k[0], 0), len(k))
        self._touched = re.compile("[" + "".join(map(re.escape, sorted(self.reach))) + "]") if self.reach else None
        if not self.escape or USER in self.kind:
            raise ValueError("models without escaped spaces or with user-defined pieces are not supported")
        self.lexicon = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kind)) if k == NORMAL}
        if any(META in p.lstrip(META) for p in self.lexicon):
            raise ValueError("a piece crosses a word boundary")
        self.byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kind)) if k == BYTE}
        self.unknown = self.kind.index(UNKNOWN) if UNKNOWN in self.kind else 0
        self.longest = max(map(len, self.lexicon), default=1)
        #: Lengths of the pieces that end in a pair of characters, the longest first.
        lengths: dict[str, set[int]] = {}
        for p in self.lexicon:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        self.ends = {k: (*sorted(v, reverse=True), 1) for k, v in lengths.items()}
        #: Texts of pieces; None where the bytes of neighbours decide.
        plain = {NORMAL: lambda p: p, UNUSED: lambda p: p, UNKNOWN: lambda p: " \u2047 ", CONTROL: lambda p: ""}
        self.plain = [
            (chr(int(p[1:-1], 16)) if int(p[1:-1], 16) < 0x80 else None) if k == BYTE else plain[k](p) for p, k in zip(self.pieces, self.kind)
        ]
        worst = min((self.score[i] for i in self.lexicon.values()), default=0.0)
        self.unknown_weight = 10.0 - worst
        self._apart: dict[int, bool] = {}
        self._last: dict[str, int] = {}
        self._bytes: dict[int, tuple[int, ...]] = {}
        self._known = _Memory(self.path, memory)
        after = {b for p in self.lexicon for a, b in zip(p, p[1:]) if a.isalpha()}
        cut = "".join(re.escape(c) for c in sorted({c for p in self.lexicon for c in p} - after) if not c.isalnum() and c not in f"_{META}")
        run = f"(?:[^{META}{cut}]+|(?<![^\\W\\d_])[{cut}])" if cut else f"[^{META}]"
        self._chunks = re.compile(f"{META}*{run}+|[{cut}]{run}*|{META}+" if cut else f"{META}*{run}+|{META}+")

    # --- the three machines -------------------------------------------------------------

    def rewritten(self, text: str) -> str:
        """The text through the arcs of the character map."""
        if self._touched is None or not self._touched.search(text):
            return text
        out, i, n = [], 0, len(text)
        while i < n:
            for size in range(self.reach.get(text[i], 0), 0, -1):
                if (to := self.rewrites.get(text[i : i + size])) is not None and i + size <= n:
                    out.append(to)
                    i += size
                    break
            else:
                out.append(text[i])
                i += 1
        return "".join(out)

    def normalise(self, text: str) -> str:
        text = self.rewritten(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (META if self.dummy else "") + text.replace(" ", META)

    def _merged(self, s: str) -> list[str]:
        """The segmentation that merging the best neighbouring pair (leftmost among equals) ends in."""
        sym, nxt, prv = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, int, str, str]] = []

        def propose(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j < len(sym):
                k = self.lexicon.get(sym[i] + sym[j])
                if k is not None:
                    heapq.heappush(heap, (-self.score[k], i, j, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            propose(i)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or nxt[i] != j:
                continue
            sym[i], sym[j], nxt[i] = a + b, "", nxt[j]
            if nxt[j] < len(sym):
                prv[nxt[j]] = i
            propose(i)
            if prv[i] >= 0:
                propose(prv[i])
        return [x for x in sym if x]

    def _text(self, piece: int) -> str:
        """The text of a piece, or of a character outside the vocabulary (numbered after the pieces)."""
        return self.pieces[piece] if piece < len(self.pieces) else chr(piece - len(self.pieces))

    def apart(self, key: int) -> bool:
        """Whether the bigram acceptor has the arc ``key``: from state ``key // ARC - 1`` (-1 at the start, else the last piece) by piece ``key % ARC``."""
        if len(self._apart) > 2 * self.memory:
            self._apart.clear()
        a, b = key // ARC - 1, self._text(key % ARC)
        got = self._apart[key] = self._merged(b) == [b] if a < 0 else self._merged(self._text(a) + b) == [self._text(a), b]
        return got

    # --- composition and shortest path -----------------------------------------------------

    def _states(self, chunk: str) -> list[int]:
        """Pieces on the one path of finite weight through the byte-pair machine.

        The path into a state depends on the prefix read alone, so the machine is determinised
        as inputs need it: ``_last`` maps each short prefix met to the piece that its path ends in.
        """
        last, lexicon, ends, table, beyond = self._last, self.lexicon, self.ends, self._apart, len(self.pieces)
        n = len(chunk)
        if len(last) > self.memory:
            last.clear()
        at: list[int | None] = [None] * (n + 1)  # the last piece on the path into each state
        at[0] = -1
        have = 0
        while have < n and have < PREFIX and (known := last.get(chunk[: have + 1])) is not None:
            have += 1
            at[have] = known
        for j in range(have + 1, n + 1):
            for size in ends.get(chunk[j - 2 : j], ONE) if j > 1 else ONE:
                i = j - size
                if i < 0:
                    continue
                before = at[i]
                if before is None:
                    continue
                piece = lexicon.get(chunk[i:j])
                if piece is None:
                    if size > 1:
                        continue
                    piece = beyond + ord(chunk[i])
                key = (before + 1) * ARC + piece
                fits = table.get(key)
                if fits if fits is not None else self.apart(key):
                    at[j] = piece
                    if j <= PREFIX:
                        last[chunk[:j]] = piece
                    break
        out = []
        while n:
            piece = at[n]
            if piece is None:
                raise ValueError("the vocabulary's merges contradict each other")
            out.append(piece)
            n -= len(self.pieces[piece]) if piece < beyond else 1
        out.reverse()
        return out

    def _cheapest(self, chunk: str) -> list[str]:
        """Pieces on the tropical shortest path through the unigram machine."""
        n = len(chunk)
        into, cost = [0] * (n + 1), [0.0] + [float("inf")] * n
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                k = self.lexicon.get(chunk[i:j])
                w = -self.score[k] if k is not None else self.unknown_weight if j - i == 1 else None
                if w is not None and cost[i] + w < cost[j]:
                    cost[j], into[j] = cost[i] + w, i
        out = []
        while n:
            out.append(chunk[into[n] : n])
            n = into[n]
        out.reverse()
        return out

    def path(self, chunk: str) -> tuple[int, ...]:
        """Ids on the shortest path of ``chunk`` through the composed machine."""
        if self.bpe:
            steps = self._states(chunk)
        else:
            steps = [self.lexicon[x] if x in self.lexicon else len(self.pieces) + ord(x) for x in self._cheapest(chunk)]
        if max(steps, default=0) < len(self.pieces):
            return tuple(steps)
        return tuple(i for k in steps for i in self.emitted(k))

    def emitted(self, arc: int) -> tuple[int, ...]:
        """The ids on an arc: a piece's own, or the byte pieces of a character outside the vocabulary."""
        if arc < len(self.pieces):
            return (arc,)
        got = self._bytes.get(arc)
        if got is None:
            got = tuple(self.byte[x] for x in chr(arc - len(self.pieces)).encode("utf-8", "surrogatepass")) if self.byte else (self.unknown,)
            self._bytes[arc] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self._known.__getitem__, self._chunks.findall(self.normalise(text or "")))))

    def decode(self, ids: list[int]) -> str:
        plain = self.plain
        try:
            text = "".join([plain[i] for i in ids])
        except TypeError:
            text = self._decode_bytes(ids)
        if (self.dummy or self.squeeze) and text.startswith(META):
            text = text[1:]
        return text.replace(META, " ")

    def _decode_bytes(self, ids: Iterable[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                held.append(int(self.pieces[i][1:-1], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.plain[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)


def read_model(path: str = MODEL) -> bytes:
    """The model file, read once where the query is built; its size is checked."""
    with open(path, "rb") as f:
        model = f.read(MODEL_LIMIT + 1)
    if len(model) > MODEL_LIMIT:
        raise ValueError(f"{path} is over {MODEL_LIMIT} bytes")
    return model


_machine: tuple[tuple[int, int], Machine] | None = None


def _compiled(model: bytes, memory: int = MEMORY) -> Machine:
    global _machine
    if _machine is None or _machine[0] != (hash(model), memory):
        _machine = (hash(model), memory), Machine(model, memory)
    return _machine[1]


def encode_documents(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", check: str | None = None, keep: list[str] | None = None, memory: int = MEMORY) -> DataFrame:
    """Columns ``keep`` of ``df`` (all, if none are named) and ``ids`` (array<int>); with ``check`` also whether decoding gives the text back.

    One pass, no shuffle; rows go back in small batches, as ids take more room than text. ``memory`` bounds what a worker remembers. ``ids`` and ``check`` replace
    columns of these names.
    """
    taken = {x.lower() for x in (ids, check) if x}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [*keep, ids, *([check] if check else [])]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), True))] + ([T.StructField(check, T.BooleanType())] if check else []))

    def run(batches):
        m = _compiled(shared.value, memory)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                texts = b.column(b.num_columns - 1).to_pylist()
                rows = [m.encode(t) for t in texts]
                cols = [*b.columns[:-1], pa.array(rows, pa.list_(pa.int32()))]
                if check:
                    cols.append(pa.array([m.decode(r) == (t or "") for r, t in zip(rows, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, names)

    own = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__sp_text"))
    return own.mapInArrow(run, schema)


def decode_documents(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the decoded text; null ids decode as empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    run = over_texts(lambda col: pa.array([_compiled(shared.value).decode(x or []) for x in col.to_pylist()], pa.string()), "string")
    return df.withColumn(text, run(F.col(f"`{ids}`")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether decoding them gives its text back."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, read_model(), check="roundtrip", keep=["doc_id"])
    return out.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "roundtrip")
