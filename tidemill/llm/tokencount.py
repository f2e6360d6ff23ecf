"""Token counts by a two-tier lookup, on the map side.

A byte-pair model never joins symbols that no vocabulary piece holds side by side. So a text can be cut, exactly, before each run of
spaces and around characters that stand in no longer piece (here line ends and tabs): each unit, a pre-token, is encoded alone and
the lengths are added. The lengths of frequent pre-tokens, found in a bounded sample of texts, are broadcast as a table of bounded
size; others are encoded once and kept in a cache of each worker, in two generations of bounded size. What is in the sample, the
table or the cache changes the speed only, never a count. Nothing is shuffled but the sampled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.runtime import columns, grouped, lean, texts

SAMPLE, PARTS = 4096, 8
TABLE, CACHE, LONG = 65_536, 100_000, 128
GROUP_BYTES = 1_000_000
LIMIT = 4096
SPACES = " ▁"  # a space, and the sign that stands for one in pieces
PROBE = "ａ  a▁ Å "


class Pieces:
    """A sentencepiece model with the places at which its texts can be cut."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path}: a piece goes on beyond a space, so texts can't be cut there")
        if self.model.normalize(PROBE) != "▁" + PROBE.replace(" ", "▁"):
            raise ValueError(f"{path}: texts are normalised before they are encoded, so they can't be cut first")
        held = set(chain.from_iterable(p for p in pieces if len(p) > 1 and not re.fullmatch("<0x..>", p)))
        self.lone = "".join(c for c in "\n\t" if c not in held)
        self.units = re.compile(f"[{SPACES}]+[^{SPACES}{self.lone}]*|[^{SPACES}{self.lone}]+" + (f"|[{self.lone}]" if self.lone else "")).findall

    def cut(self, text: str) -> list[str]:
        return self.units(f" {text}") if text else []

    def lengths(self, units: list[str]) -> list[int]:
        """Tokens of each unit: one that begins with a space loses it to the space that the model puts first; others go behind a character that joins nothing."""
        found = self.model.encode([u[1:] if u[0] in SPACES else self.lone[0] + u for u in units], num_threads=1)
        # a unit of a single space is nothing but the space that the model puts before other text, and not before none
        more = 1 + len(self.model.encode(self.lone[:1] * 2)) - len(self.model.encode(self.lone[:1])) if self.lone else 0
        return [len(x) - more if u[0] not in SPACES else len(x) if len(u) > 1 else 1 for u, x in zip(units, found)]


class Lookup:
    """Lengths of units: from the table, else from this worker's cache, else encoded and cached, if not very long."""

    def __init__(self, pieces: Pieces, table: dict[str, int]):
        self.pieces, self.table, self.young, self.old = pieces, table, {}, {}

    def resolve(self, units: set[str]) -> dict[str, int]:
        """The lengths of those units that the table doesn't have."""
        rest = units - self.table.keys()
        known = {u: n for u in rest if (n := self.young.get(u) or self.old.get(u))}
        new = [u for u in rest if u not in known]
        made = dict(zip(new, self.pieces.lengths(new))) if new else {}
        for u, n in (known | made).items():
            if len(u) <= LONG:
                if len(self.young) >= CACHE:
                    self.young, self.old = {}, self.young
                self.young[u] = n
        return known | made

    def counts(self, bodies: list[str]) -> list[int]:
        cuts = [self.pieces.cut(b) for b in bodies]
        known = self.table | self.resolve(set(chain.from_iterable(cuts)))
        return [sum(map(known.__getitem__, c)) for c in cuts]


_workers: dict[str, Lookup] = {}  # that of the last run that this worker took part in


def frequent(docs: DataFrame, model: str) -> dict[str, int]:
    """Tokens of the pre-tokens found most often in a sample of about SAMPLE texts: TABLE of them at most, none longer than LONG. What
    reaches the driver is bounded by PARTS x TABLE pre-tokens."""
    n = docs.count()
    taken = docs.select("text").where(F.col("text").isNotNull()).sample(min(1.0, SAMPLE / n), 7) if n else docs.select("text").limit(0)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = Pieces(model), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(u for u in pieces.cut(text) if len(u) <= LONG)
                if len(seen) > 8 * TABLE:
                    seen = Counter(dict(seen.most_common(4 * TABLE)))
        best = seen.most_common(TABLE)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in best], pa.string()), pa.array([k for _, k in best], pa.int64())], names=["unit", "n"])

    total: Counter = Counter()
    for r in taken.repartition(PARTS).mapInArrow(top, "unit string, n long").toLocalIterator():
        total[r["unit"]] += r["n"]
    best = [u for u, k in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:TABLE] if k > 1]
    return dict(zip(best, Pieces(model).lengths(best))) if best else {}


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens (long), over_limit: a row per document, n_tokens as sentencepiece gives them for the whole text.

    model: path of a byte-pair model that leaves texts as they are before encoding (others are refused); it must be on every node.
    Null and empty texts have no bytes and no tokens; texts of any length are counted whole, a batch of about 1 MB at a time; a
    pre-token of any length is encoded whole, and the longest are not cached; strings like <s> are ordinary text; repeated rows and
    rows without doc_id count like others; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    held, run = spark.sparkContext.broadcast(frequent(docs, model)), uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if run not in _workers:
            _workers.clear()
            _workers[run] = Lookup(Pieces(model), held.value)
        lookup = _workers[run]
        for group in grouped(batches, GROUP_BYTES):
            ids, bodies = columns(group, "doc_id", "text")
            n = lookup.counts([(b or b"").decode() for b in bodies])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(b or b"") for b in bodies], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
