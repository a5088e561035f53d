"""Token counts of a SentencePiece BPE vocabulary by the whole-token shortcut.

Offline, once per vocabulary and process, it is proved which strings the
library encodes alone as one token, and that no piece joins two pre-tokens.
Pre-tokens of that kind then count as one by lookup; only the others are merged
by the library, each distinct one once per batch.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import map_rows

CACHE = 250_000


class Counter:
    """Counts as the library gives them for ``encode(text)`` with its defaults."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        # Space marks stand only at the start of a piece, so no merge crosses from a word into the next mark;
        # line feeds are in no piece, so none crosses them.  A mark may be dropped or added only where the
        # library does it for a text's start.
        inside = any("▁" in p.lstrip("▁") for p in pieces)
        feeds = any("\n" in p for p in pieces)
        plain = self.sp.encode(" a  b ", out_type=str)
        self.provable = not inside and not feeds and "".join(plain) == "▁▁a▁▁b▁"
        #: Strings after a space that the library encodes alone as one token.
        words = [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1 and p[1] != "▁"]
        self.spaced: dict[str, int] = {w: 1 for w, ids in zip(words, self.sp.encode(words, num_threads=1)) if len(ids) == 1}
        self.proved = len(self.spaced)
        #: The same at the start of a line: the library sees them behind a line feed, which takes a mark's token and its own.
        bare = [p for p in pieces if "▁" not in p]
        self.line = len(self.sp.encode("\n"))
        self.bare: dict[str, int] = {w: 1 for w, ids in zip(bare, self.sp.encode([f"\n{w}" for w in bare], num_threads=1)) if len(ids) == self.line + 1}
        self.base = dict(self.spaced), dict(self.bare)
        self.odd = re.compile("[\x00▁�\ud800-\udfff]")

    def count(self, texts: list[str]) -> list[int]:
        out, again = [0] * len(texts), []
        cut: list[tuple[int, list[list[str]]]] = []
        spaced, bare = set(), set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.provable or self.odd.search(text) or "  " in text or text[0] in " \n" or " \n" in text or text[-1] == " ":
                again.append(i)
                continue
            lines = [x.split(" ") for x in text.split("\n")]
            cut.append((i, lines))
            for k, line in enumerate(lines):
                spaced.update(line[1:])
                (bare if k else spaced).add(line[0])
        self._learn(spaced, self.spaced, "")
        self._learn(bare, self.bare, "\n")
        sp, ba = self.spaced.__getitem__, self.bare.__getitem__
        for i, lines in cut:
            n = len(lines) - 1
            for k, line in enumerate(lines):
                if k:
                    if line[0]:
                        n += ba(line[0])
                    n += sum(map(sp, line[1:]))
                else:
                    n += sum(map(sp, line))
            out[i] = n
        for i, ids in zip(again, self.sp.encode([texts[i] for i in again], num_threads=1) if again else ()):
            out[i] = len(ids)
        return out

    def forget(self) -> None:
        for known, base in zip((self.spaced, self.bare), self.base):
            known.clear()
            known.update(base)

    def _learn(self, words: set[str], known: dict[str, int], before: str) -> None:
        new = [w for w in words if w and w not in known]
        if len(known) + len(new) > CACHE + self.proved:
            known.clear()
            known.update(self.base[1 if before else 0])
            new = [w for w in words if w and w not in known]
        less = self.line if before else 0
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            known.update(zip(some, (len(x) - less for x in self.sp.encode([before + w for w in some] if before else some, num_threads=1))))


@lru_cache(2)
def counter(model_file: str) -> Counter:
    return Counter(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, equal to the library's own count.

    Returns ``doc_id, n_bytes, n_tokens, over_limit``.  Null texts count as
    empty and have no tokens.  Texts with repeated spaces, space marks or other
    cases that the proof leaves out are encoded by the library as a whole.
    """

    def run(cols: list[list]) -> dict[str, list]:
        texts = [t or "" for t in cols[1]]
        n = counter(model_file).count(texts)
        return {"doc_id": cols[0], "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", done=lambda: counter(model_file).forget())
