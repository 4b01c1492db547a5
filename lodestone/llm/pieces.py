"""SentencePiece (BPE) encoding and decoding by a prefix table.

Method. Every prefix of a text has one encoding, and that encoding has one last token. For each
prefix the table stores this token: an Aho-Corasick automaton yields the vocabulary entries that end
there, and the entry is the last token exactly if it may stand behind the last token of the prefix
before it (pair compatibility). Walking the table from the end gives the ids.

Merges never cross from a non-space character to a space mark, because no piece has a space mark
inside (checked when the model is loaded), so a text is encoded segment by segment: a run of space
marks and what follows. Segments recur, and each Python worker keeps a bounded table of them from task to
task, until another operator works in it; then only the vocabulary stays.

The model must leave texts as they are but for a space mark in front and for every space: this is
tried when it is loaded. Null texts count as empty; an empty text has no ids and decodes to the empty text. Texts are encoded
whole, whatever their length. Repeated rows give repeated results, an empty table none.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.batches import kept, slices
from lodestone.session import table

MARK = "▁"
#: Segments and pair tests that a worker keeps; beyond that the table starts anew.
KEPT_SEGMENTS = 300_000
KEPT_PAIRS = 1_200_000


class PieceModel:
    """Vocabulary, automaton and pair tests of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [sp.unk_id()] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.bytes_of[i] = i, piece.encode()
        # what a normaliser would change: width, case, ligatures, runs of spaces, blanks at the ends
        trial = "  Ａé  ﬁ\tK x²\u00a0 "
        if sp.decode(sp.encode(trial)) != trial or not sp.id_to_piece(sp.encode("a")[0]).startswith(MARK):
            raise ValueError("the model normalises texts: only models that leave them as they are can be used")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece has a space mark inside: texts can't be cut at space marks")
        order = sorted(self.ids.values(), key=lambda i: -sp.get_score(i))
        #: Smaller merges first; pieces of equal score share a rank.
        self.rank, at, last = {}, -1, None
        for i in order:
            at, last = (at, last) if sp.get_score(i) == last else (at + 1, sp.get_score(i))
            self.rank[i] = at
        self.text_of = {i: p for p, i in self.ids.items()}
        #: How a piece comes about: its two halves, or None for a single character.
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.halves[i] = None
            elif set(piece) != {MARK} and (parts := self.merged(piece, stop=i)) is not None:
                self.halves[i] = parts
            else:
                continue  # no text ever yields it, or a run of marks, which merged() handles
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.late = {i for i in self.halves if self._late(i)}

    def _late(self, i: int) -> bool:
        """A half is ranked behind the whole, so ranks don't tell the order of merges."""
        halves = self.halves[i]
        return halves is not None and any(self.halves.get(h) is not None and (self.rank[h] >= self.rank[i] or self._late(h)) for h in halves)

    def merged(self, text: str, stop: int | None = None) -> list | tuple | None:
        """The definition: merge the best adjacent pair, leftmost first, until none is left.

        Gives the parts as texts; with ``stop`` the two halves of the merge that made this piece of
        the whole text, or None.
        """
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(part) and (i := self.ids.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (self.rank[i], a, len(part[a]) + len(part[b])))

        for k in range(len(part) - 1):
            offer(k)
        while heap:
            _, a, size = heapq.heappop(heap)
            b = after[a]
            if not part[a] or b >= len(part) or len(part[a]) + len(part[b]) != size:
                continue
            if stop is not None and size == len(text):
                return self.ids[part[a]], self.ids[part[b]]
            part[a], part[b] = part[a] + part[b], ""
            after[a] = after[b]
            if after[a] < len(part):
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return None if stop is not None else [p for p in part if p]

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens a, b stay apart when their characters are merged.

        Going back in time, the later of the two tokens is undone, and what then met at the border
        must not have merged earlier than the halves did.
        """
        if a in self.late or b in self.late:
            return self.merged(self.text_of[a] + self.text_of[b]) == [self.text_of[a], self.text_of[b]]
        rank, halves, ids, text = self.rank, self.halves, self.ids, self.text_of
        until, on_tie = 1 << 60, False  # the border merge must not come before this; on_tie: nor at it
        while True:
            both = ids.get(text[a] + text[b])
            if both is not None and (rank[both] < until or (on_tie and rank[both] == until)):
                return False
            undo_a, undo_b = halves[a], halves[b]
            if undo_a is None and undo_b is None:
                return True
            # of equal ranks the left one was merged first, so the right one is undone first
            if undo_b is None or (undo_a is not None and rank[a] > rank[b]):
                until, on_tie, a = rank[a], False, undo_a[1]
            else:
                until, on_tie, b = rank[b], True, undo_b[0]

    def _known(self, text: str, pairs: dict[int, bool]) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary, without runs of marks."""
        last, size = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        bad = 0
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        for end, (i, n) in self.automaton.iter(text):
            end += 1
            if size[end]:
                continue
            a = last[end - n]
            if end != n:
                key = a << 32 | i
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = a >= 0 and self.fits(a, i)
                if not ok:
                    continue
            last[end], size[end] = i, n
        out, end = [], len(text)
        while end and not bad:
            bad = not size[end]
            out.append(last[end])
            end -= size[end]
        return [self.ids[p] for p in self.merged(text)] if bad else out[::-1]

    def segment_ids(self, text: str, pairs: dict[int, bool]) -> list[int]:
        """Ids of one segment; characters outside the vocabulary become bytes. ``pairs`` remembers which tokens may stand side by side."""
        if text.startswith(MARK * 2):
            return [j for p in self.merged(text) for j in ((self.ids[p],) if p in self.ids else map(self.byte_ids.__getitem__, p.encode()))]
        ids, out, begin = self.ids, [], 0
        for k, c in enumerate(text):
            if c not in ids:
                if begin < k:
                    out += self._known(text[begin:k], pairs)
                out += map(self.byte_ids.__getitem__, c.encode())
                begin = k + 1
        return out + self._known(text[begin:], pairs) if begin < len(text) else out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")


class SegmentTable(dict):
    """segment → (ids joined by commas, decoded segment), filled on demand and bounded."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.pairs = model, {}

    def __missing__(self, text: str) -> tuple[str, str]:
        ids = self.model.segment_ids(text, self.pairs)
        found = ",".join(map(str, ids)), self.model.decode(ids)
        if len(text) <= 64:
            if len(self) >= KEPT_SEGMENTS:
                self.clear()
            self[text] = found
        return found


@lru_cache(maxsize=1)
def piece_model(path: str) -> PieceModel:
    """The vocabulary, loaded once in a worker."""
    return PieceModel(path)


SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def encode_text(segments: SegmentTable, text: str | None) -> tuple[str, str]:
    """(ids joined by commas, text decoded from the ids)."""
    if not text:
        return "", ""
    found = [segments[s] for s in SEGMENT.findall(MARK + text.replace(" ", MARK))]
    return ",".join([x[0] for x in found]), "".join([x[1] for x in found])[1:]


def encode_documents(docs: DataFrame, model_path: str, digests: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row's whole text.

    With ``digests``: (id, n_tokens, ids_sha256, decoded_sha256); else (id, ids, decoded). Other
    columns are left out, so their names can't clash. Each row is handled on its own: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        segments = kept("pieces", lambda: SegmentTable(model))
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        for part in (x for batch in batches for x in slices(batch, 1, rows=256, keep="pieces")):
            done = [encode_text(segments, t) for t in part.column(1).to_pylist()]
            if digests:
                columns = [pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in done], pa.int64()), pa.array([sha(ids) for ids, _ in done]), pa.array([sha(text) for _, text in done])]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns = [pa.array([list(map(int, ids.split(","))) if ids else [] for ids, _ in done], pa.list_(pa.int32())), pa.array([text for _, text in done], pa.string())]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, *names])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(run, f"{id_col} {kind}, {out}")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(table(spark, sf_dir, "documents"), model_path())
