"""SentencePiece encoding and decoding for merge-type vocabularies.

Symbols start as single characters.  An agenda (a heap) holds adjacent pairs
whose join is a piece, best score first and leftmost among equals; popping a
pair joins it and offers its two new neighbours.  Entries whose symbols have
changed since are stale and skipped.

No merge can cross a place where no piece has the two characters side by side,
so a text is cut there, and each distinct unit is merged once per worker and
remembered in a bounded cache.  New units are compared with the sentencepiece
library, one call for each Arrow batch; a difference ends the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from textloom.llm.common import map_texts

SPACE_MARK = "▁"
#: Units per cache generation and longest unit that is remembered.
CACHE_UNITS, CACHE_CHARS = 300_000, 48


class UnitCache(dict):
    """Unit -> ids, in two generations so that its size stays bounded."""

    def __init__(self, encode, older=None):
        super().__init__()
        self.encode, self.older = encode, older or {}

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = self.encode(unit)
        if len(unit) <= CACHE_CHARS:
            self[unit] = found
        return found


class Vocabulary:
    """Pieces, scores and settings of a model file, with the merge rule."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        norm, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only merge-type vocabularies with the identity normaliser")
        if trained.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only vocabularies that mark white space in front")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        order = {score: r for r, score in enumerate(sorted({x[2] for x in normal}, reverse=True))}
        self.rank = {piece: order[score] for _, piece, score in normal if len(piece) > 1}
        self.packed = {piece: self._pack(i) for i, piece, _ in normal}
        self.byte_ids = [self._pack(i) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE]
        self.longest = max(map(len, self.packed), default=1)
        self.unknown, self.begin, self.end = trained.unk_id, trained.bos_id, trained.eos_id
        self.prefix = SPACE_MARK if norm.add_dummy_prefix else ""
        self.inner = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        cut = all(x[1] != SPACE_MARK or x[0] == SPACE_MARK for x in self.inner) and not any("\n" in x for x in self.inner)
        mark = SPACE_MARK
        self.units = re.compile(f"{mark}*[^{mark}\n]+|{mark}+|\n" if cut else "(?s).+")
        self.cache = UnitCache(self._unit)
        self.unchecked: dict[str, bytes] = {}

    @staticmethod
    def _pack(i: int) -> bytes:
        return i.to_bytes(4, "little")

    def merge(self, unit: str) -> list[str]:
        """The pieces of a unit.

        A symbol is known by its start and size.  An agenda entry packs score
        order, start and joined size into one integer, so the smallest entry is
        the best and then the leftmost pair.  It is stale when the symbols that
        now start there do not have that size together.
        """
        n = len(unit)
        rank, longest = self.rank.get, self.longest
        width = longest + 1
        agenda = []
        for i in range(n - 1):
            r = rank(unit[i : i + 2])
            if r is not None:
                agenda.append((r * n + i) * width + 2)
        if not agenda:
            return list(unit)
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        size = [1] * n
        left = list(range(-1, n))  # by end of a symbol: where it starts
        while agenda:
            entry, joined = divmod(pop(agenda), width)
            i = entry % n
            here = size[i]
            j = i + here
            if not here or j >= n or here + size[j] != joined:
                continue
            size[i], size[j] = joined, 0
            k = i + joined
            left[k] = i
            if k < n:
                wide = joined + size[k]
                if wide <= longest:
                    r = rank(unit[i : i + wide])
                    if r is not None:
                        push(agenda, (r * n + i) * width + wide)
            if i:
                h = left[i]
                if k - h <= longest:
                    r = rank(unit[h:k])
                    if r is not None:
                        push(agenda, (r * n + h) * width + k - h)
        return [unit[i : i + size[i]] for i in range(n) if size[i]]

    def _piece(self, piece: str) -> bytes:
        found = self.packed.get(piece)
        if found is None:
            found = b"".join([self.byte_ids[b] for b in piece.encode()]) if self.byte_ids else self._pack(self.unknown)
        return found

    def _subunits(self, unit: str) -> list[str]:
        """Cut where no piece has the two characters side by side."""
        inner = self.inner
        cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in inner]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])] if cuts else [unit]

    def _unit(self, unit: str) -> bytes:
        """Ids of a new unit as little-endian 32-bit integers."""
        parts = self._subunits(unit)
        if len(parts) > 1:
            found = b"".join([self.cache[p] for p in parts])
        else:
            found = b"".join(map(self._piece, self.merge(unit)))
        if len(parts) == 1 or len(unit) > CACHE_CHARS:
            self.unchecked[unit] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text with begin and end."""
        marked = self.prefix + text.replace(" ", SPACE_MARK) if text else ""
        data = b"".join(map(self.cache.__getitem__, self.units.findall(marked)))
        if len(self.cache) >= CACHE_UNITS:
            self.cache = UnitCache(self._unit, dict(self.cache))
        ids = np.empty(len(data) // 4 + 2, dtype="<u4")
        ids[0], ids[-1] = self.begin, self.end
        ids[1:-1] = np.frombuffer(data, dtype="<u4")
        if not self.byte_ids:  # the library joins neighbouring unknown symbols
            again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            ids = ids[np.concatenate(([True], ~again))]
        return ids

    def check_new_units(self) -> None:
        """Compare every unit met since the last call with the library."""
        new = list(self.unchecked.items())
        self.unchecked = {}
        lead = np.array(self.library.encode("\n"), dtype="<u4").tobytes()
        texts = ["\n" + u.replace(SPACE_MARK, " ") for u, _ in new]
        for (unit, mine), theirs in zip(new, self.library.encode(texts, num_threads=1) if texts else []):
            if lead + mine != np.array(theirs, dtype="<u4").tobytes():
                raise RuntimeError(f"the library encodes {unit!r} in another way")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and model file."""
    return Vocabulary(path)


def encode_decode(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode every whole text with begin and end ids, then decode the ids.

    Columns: the key, n_tokens (all ids), ids_sha256 (ids as little-endian
    unsigned 32-bit integers), decoded_sha256 (decoded text in UTF-8) and, if
    wanted, ids and decoded.  A null text counts as empty: two ids and an empty
    decoded text.  Every row gives one row, repeated rows and null keys too; an
    empty table gives none; other columns are not read.  One pass, no shuffle.
    ``model`` is a path that exists on every worker.
    """

    def compute(texts: list[bytes | None]) -> dict:
        vocab = vocabulary(model)
        found: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for raw in texts:
            ids = vocab.encode((raw or b"").decode("utf-8", "replace"))
            plain = vocab.library.decode(ids.tolist())
            found["n_tokens"].append(len(ids))
            found["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            found["decoded_sha256"].append(hashlib.sha256(plain.encode()).hexdigest())
            if with_ids:
                found["ids"].append(ids.tolist())
                found["decoded"].append(plain)
        vocab.check_new_units()
        return found

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, text, [key], added + (", ids array<long>, decoded string" if with_ids else ""), compute)
