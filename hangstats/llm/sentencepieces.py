"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A text is cut where no piece of the vocabulary can reach across, so each cut is
encoded on its own and its result is kept for the next time. Within a cut:

* an Aho-Corasick automaton over the pieces finds the longest piece at a position;
* that piece is tried first, then the shorter ones it begins with; it may follow the piece before it only if
  merging their joined text anew gives the same two pieces;
* if no piece fits, the position is marked in a bitfield as failed and the
  piece before it is given up for a shorter one.

A sequence whose neighbours are all compatible is the one that merging the whole
text by score gives. Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hangstats.llm.common import id_and_text, map_rows

SPACE = "▁"
#: Letters of the Latin script; everything else but the space mark counts as the other class.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Cuts of up to so many characters are remembered, up to so many of each process, and so many pairs: some 100 MB.
_KEPT_LENGTH, _KEPT, _KEPT_PAIRS = 40, 200_000, 300_000


class PieceCodec:
    """Encoder and decoder for one BPE model with byte fallback and no text normalisation."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        plain = [
            i
            for i in range(len(self.pieces))
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.known = set("".join(self.ids))
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self._merge(piece) == [piece]:
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        #: The longest shorter piece that a piece begins with; "" if there is none.
        self.shorter = {
            piece: next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.automaton), "")
            for piece in self.automaton
        }
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cuts: dict[str, tuple[str, str]] = {}
        self.cut = re.compile(self._cut_pattern())

    def _cut_pattern(self) -> str:
        """Cuts that no piece crosses: at space marks and, if the vocabulary allows it, between letters and others."""
        letter, inner = re.compile(f"[{_LETTER}]"), [p.lstrip(SPACE) for p in self.ids]
        if any(SPACE in p for p in inner):
            return r"(?s).+"
        mixed = any(len({bool(letter.match(c)) for c in p}) > 1 for p in inner)
        body = f"[^{SPACE}]+" if mixed else f"[{_LETTER}]+|[^{_LETTER}{SPACE}\n]+|\n+"
        return f"{SPACE}*(?:{body})|{SPACE}+" if "\n" not in self.known else f"{SPACE}*[^{SPACE}]+|{SPACE}+"

    def _merge(self, text: str) -> list[str]:
        """Merging by score, the leftmost first among equal ones; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= _KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._merge(left + right) == [left, right]
        return found

    def _known_run(self, text: str) -> list[str]:
        """Backtracking over a text whose characters are all in the vocabulary."""
        longest, shorter, pairs = self.automaton.iter_long, self.shorter, self.pairs
        failed = bytearray((len(text) >> 3) + 1)  # bit i: what was chosen before i leads nowhere
        chosen: list[str] = []
        position, total = 0, len(text)
        piece: str | None = None
        found, found_at = longest(text), 0  # the automaton goes on while the longest pieces fit
        while position < total:
            if piece is None:
                if position != found_at:
                    found = longest(text, position)
                found_at = next(found)[0] + 1
                piece = text[position:found_at]
            while piece:
                end = position + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not chosen:
                        break
                    key = (chosen[-1], piece)
                    fits = pairs.get(key)
                    if self._compatible(*key) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece:
                chosen.append(piece)
                position += len(piece)
                piece = None
            else:
                if not chosen:
                    raise ValueError("the vocabulary lacks a character that its pieces have")
                failed[position >> 3] |= 1 << (position & 7)
                last = chosen.pop()
                position -= len(last)
                piece = shorter[last]
        return chosen

    def _encode_cut(self, text: str) -> list[int]:
        if self.known.issuperset(text):
            return [self.ids[p] for p in self._known_run(text)]
        ids: list[int] = []
        start = 0
        for i, char in enumerate(text):
            if char not in self.known:
                if start < i:
                    ids += [self.ids[p] for p in self._known_run(text[start:i])]
                ids += [self.byte_ids[b] for b in char.encode()]
                start = i + 1
        if start < len(text):
            ids += [self.ids[p] for p in self._known_run(text[start:])]
        return ids

    def _pieces_text(self, ids: list[int]) -> str:
        """Piece texts joined; runs of byte pieces are read as UTF-8."""
        if self.id_bytes.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, None]:
            if i in self.id_bytes:
                raw.append(self.id_bytes[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i is not None:
                out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def _coded(self, cut: str) -> tuple[str, str]:
        ids = self._encode_cut(cut)
        found = (",".join(map(str, ids)), self._pieces_text(ids))
        if len(cut) <= _KEPT_LENGTH:
            if len(self.cuts) >= _KEPT:
                self.cuts.clear()
            self.cuts[cut] = found
        return found

    def code(self, text: str) -> tuple[str, str]:
        """The ids, joined by commas, and the text they decode to."""
        if not text:
            return "", ""
        known, coded = self.cuts.get, self._coded
        parts = [known(cut) or coded(cut) for cut in self.cut.findall(SPACE + text.replace(" ", SPACE))]
        return ",".join([p[0] for p in parts]), "".join([p[1] for p in parts])[1:]

    def encode(self, text: str) -> list[int]:
        ids = self.code(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space before the first word, which encoding adds, goes."""
        text = self._pieces_text(ids)
        return text[1:] if text.startswith(" ") and ids and ids[0] not in self.id_bytes else text


@functools.lru_cache(maxsize=4)
def codec(model_file: str) -> PieceCodec:
    """One codec for each process and model."""
    return PieceCodec(model_file)


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text, and digests of the ids and of the text they decode to.

    A row for each row of ``docs``: NULL and empty texts have no ids and the
    digest of the empty string; repeated rows and NULL ids of documents stay.
    ``model_file`` must be readable on every executor. ``with_ids`` adds the
    ids themselves as ``ids array<int>``.
    """

    def work(table: pa.Table) -> dict[str, list]:
        coder = codec(model_file)
        out: dict[str, list] = {
            "doc_id": table.column("doc_id").to_pylist(), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []
        }
        for text in table.column("text").to_pylist():
            ids, decoded = coder.code(text or "")
            out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                out["ids"].append(np.fromstring(ids, dtype=np.int32, sep=",") if ids else np.empty(0, np.int32))
        return out

    return map_rows(id_and_text(docs), SCHEMA + ", ids array<int>" * with_ids, work)
