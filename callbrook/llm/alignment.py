"""Cross-tokenizer alignment by token spans.

Tokenizer A (``tokenizers``, byte-level) encodes a space and the text, tokenizer B (``sentencepiece``, byte fallback) the text, before
which it puts a space itself.  Both libraries tell each token's span in code points.  Positions where a span of A and one of B end
are the coarse cuts; inside them the tokens' decoded bytes give the byte offsets, which also places tokens that hold a part of a
multibyte character.  Between two neighbouring ends of either side one token of A and one of B overlap: a link.

Neither tokenizer joins across a space that stands between two other characters, so a text is a row of units, each a space and what
follows.  Many units are encoded in one call and every unit of a block of documents is aligned once.  A block is a bounded amount of
text of one task.  It reports each linked id pair with the number of its documents that hold it; only these sums are shuffled, and
each block gets back the corpus-wide counts of the pairs it holds.

Defined results: null and empty texts, and texts whose bytes either tokenizer does not give back, have no tokens: zeros and an empty
digest.  Each row is a document, repeated rows too; a null id is kept.  An empty table gives an empty table.  Only ``id_col`` and
``text_col`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callbrook.session import written

#: A block ends after so many code points; units longer than LONG are not remembered beyond their block.
BLOCK, LONG, REMEMBERED = 1 << 24, 64, 1 << 18
_JOINT = re.compile(r"(?<=\S)(?= \S)")
_ENCODED = ("block long, doc_id long, groups_sha256 string, n_a long, n_b long, n_groups long, n_links long, units array<int>, "
            "unit_pairs array<int>, unit_starts array<int>, a array<int>, b array<int>, c array<long>")
_NAMES = [x.split()[0] for x in _ENCODED.split(", ")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_TYPES = [_ARROW[x.split()[1]] for x in _ENCODED.split(", ")]


def byte_table() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # in a text they are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        of = byte_table()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of[ch] for ch in token) if all(ch in of for ch in token) else token.encode()
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        # pieces with a space after another character would join units
        self.joins = any(re.search("[^▁]▁", piece(i)) for i in range(self.b.get_piece_size()))
        self.digits = [str(i) + mark for ids, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for mark in marks for i in range(ids)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def units(self, text: str) -> list[str]:
        """``text`` with a space before it, cut before the spaces that no token crosses; each without its space."""
        return [u[1:] for u in _JOINT.split(" " + text)] if not self.joins else [text]

    def encoded(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and span ends of A, then of B, in code points of ``joined``, which begins with the space that B adds."""
        e = self.a.encode(joined, add_special_tokens=False)
        m = self.b.encode(joined[1:], return_type="offset_mapping")
        a, b = (np.fromiter([end for _, end in x], np.int64, len(x)) for x in (e.offsets, m["offsets"]))
        # the bytes of one character: all but the last have an empty span, before it
        b = np.minimum.accumulate(np.where(np.diff(b, prepend=0) > 0, b, len(joined))[::-1])[::-1]
        return np.array(e.ids, np.int64), a, np.array(m["ids"], np.int64), b + 1


def _fine_ends(spans: np.ndarray, sizes: np.ndarray, cuts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte end of each token: from the coarse cut before it, its decoded bytes are added up."""
    upto, last = np.cumsum(sizes), np.searchsorted(spans, cuts, "right")
    part = np.searchsorted(last, np.arange(len(sizes)), "right")
    begins = np.concatenate([[0], at[cuts]])
    return upto + (begins - np.concatenate([[0], upto[last - 1]]))[part]


def align(pair: Pair, units: list[str]) -> list[tuple | None]:
    """For each unit ``(n_a, n_b, n_groups, pairs, groups)``; none where the bytes differ.  ``pairs`` has an ``a << 32 | b`` a link;
    each of the groups ends with a semicolon."""
    joined = " " + " ".join(units)
    raw = joined.encode()
    ids_a, span_a, ids_b, span_b = pair.encoded(joined)
    bytes_a, bytes_b = [pair.a_bytes[i] for i in ids_a.tolist()], [pair.b_bytes[i] for i in ids_b.tolist()]
    stop = np.cumsum([len(u) + 1 for u in units])
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        if len(units) == 1:
            return [None]
        i, j = (np.searchsorted(s, stop, "right").tolist() for s in (span_a, span_b))
        good = [b"".join(bytes_a[a:c]) == x and b"".join(bytes_b[b:d]) == x for x, a, b, c, d in
                zip(((" " + u).encode() for u in units), [0, *i], [0, *j], i, j)]
        fine = [u for u, ok in zip(units, good, strict=True) if ok]
        found = iter(align(pair, fine) if 0 < len(fine) < len(units) else [])
        # a neighbour's change may shift spans, so the others are tried alone
        return [next(found) if ok and len(fine) < len(units) else align(pair, [u])[0] for u, ok in zip(units, good, strict=True)]
    at = np.arange(len(raw) + 1) if len(raw) == len(joined) else \
        np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw))
    cuts = np.intersect1d(span_a, span_b)
    cuts = cuts[cuts > 0]
    end_a, end_b = _fine_ends(span_a, pair.a_size[ids_a], cuts, at), _fine_ends(span_b, pair.b_size[ids_b], cuts, at)
    ends = np.sort(np.concatenate([end_a, end_b]))
    new = np.diff(ends, prepend=-1) > 0
    both, either = ends[~new], ends[new]
    codes = ids_a[np.searchsorted(end_a, either)] << 32 | ids_b[np.searchsorted(end_b, either)]
    group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    n, m = len(pair.a_bytes), len(pair.b_bytes)
    # tokens of A with a comma or a bar, of B with a comma or a semicolon, in the order of the groups, A first
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    parts = [pair.digits[k] for k in np.concatenate([ids_a + n * last_a, 2 * n + ids_b + m * last_b])[order].tolist()]
    n_a, n_b, n_g, n_l = (np.searchsorted(e, at[stop], "right").tolist() for e in (end_a, end_b, both, either))
    out, a, b, g, k = [], 0, 0, 0, 0
    for a2, b2, g2, k2 in zip(n_a, n_b, n_g, n_l):
        out.append((a2 - a, b2 - b, g2 - g, codes[k:k2], "".join(parts[a + b:a2 + b2])))
        a, b, g, k = a2, b2, g2, k2
    return out


class Block:
    """The documents of a bounded stretch of a task's rows; units have numbers in order of appearance."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.of: dict[str, int] = {}
        self.found: list[tuple | None] = []
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.odd: set[str] = set()  # words that are no units, as more white space is beside them

    def add(self, pair: Pair, memory: dict, keys: list, texts: list) -> None:
        cut = [t.split(" ") if t else [] for t in texts]
        new = [u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in self.of]
        odd = {u for u in new if not u or u[0].isspace() or u[-1].isspace()} | self.odd
        if odd or pair.joins:
            self.odd |= odd
            cut = [pair.units(t) if t and (pair.joins or not odd.isdisjoint(us)) else us for t, us in zip(texts, cut, strict=True)]
            new = [u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in self.of]
        unseen, size, part = [u for u in new if u not in memory], 0, []
        for u in unseen:
            if not u or u[0].isspace() or u[-1].isspace():  # at the edge of a text: no neighbours
                memory[u] = align(pair, [u])[0]
                continue
            part.append(u)
            size += len(u)
            if size >= 1 << 16:
                memory.update(zip(part, align(pair, part), strict=True))
                part, size = [], 0
        if part:
            memory.update(zip(part, align(pair, part), strict=True))
        for u in new:
            self.of[u] = len(self.found)
            self.found.append(memory[u])
        for u in unseen:
            if len(u) > LONG:
                del memory[u]
        if len(memory) > REMEMBERED:
            memory.clear()
        for key, us in zip(keys, cut, strict=True):
            self.docs.append((key, np.fromiter(map(self.of.__getitem__, us), np.int32, len(us))))
        self.chars += sum(len(t or "") for t in texts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row a document, then one with the block's units and pairs."""
        good = np.array([f is not None for f in self.found], bool)
        none = (0, 0, 0, np.zeros(0, np.int64), "")
        found = [f or none for f in self.found]
        n_a, n_b, n_g, n_l = (np.array(x, np.int64) for x in
                              ([f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [len(f[3]) for f in found]))
        starts = np.concatenate([[0], np.cumsum(n_l)])
        codes, of = np.unique(np.concatenate([f[3] for f in found] or [none[3]]), return_inverse=True)
        of = of.astype(np.int32)
        holds, out, groups = np.zeros(len(codes), np.int64), [], [f[4] for f in found]
        for k, (key, u) in enumerate(self.docs):
            if not len(u) or not good[u].all():
                out.append((self.number, key, "", 0, 0, 0, 0, u[:0]))
            else:
                digest = hashlib.sha256("".join([groups[i] for i in u.tolist()])[:-1].encode()).hexdigest()
                out.append((self.number, key, digest, *(int(x[u].sum()) for x in (n_a, n_b, n_g, n_l)), u))
                held = np.sort(of[slices(starts, u)])
                holds[held[np.diff(held, prepend=-1) > 0]] += 1
            if len(out) == 512 or k == len(self.docs) - 1:
                yield _batch([*zip(*out, strict=True), *[[None] * len(out)] * 5])
                out = []
        used = np.flatnonzero(holds)  # pairs of rejected texts are held by none
        place = np.full(len(codes), -1, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        yield _batch([[self.number], *[[None]] * 7, [place[of]], [starts.astype(np.int32)], [(codes[used] >> 32).astype(np.int32)],
                      [(codes[used] & 0xFFFFFFFF).astype(np.int32)], [holds[used]]])


def slices(starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions ``starts[k]`` up to ``starts[k + 1]`` of each ``k`` of ``which``, one after the other."""
    n = starts[which + 1] - starts[which]
    return np.repeat(starts[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def alignments(docs: DataFrame, a_name: str = "byte_bpe_50k.json", b_name: str = "piece_bpe_32k.model", id_col: str = "doc_id",
               text_col: str = "text", block: int = BLOCK, path=public_path) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first, k = TaskContext.get().partitionId() << 32, 0
        pair, memory, current = None, {}, None
        for batch in batches:
            pair = pair or Pair(path(a_name), path(b_name))
            for at in range(0, batch.num_rows, 128):
                current = current or Block(first + k)
                current.add(pair, memory, *(batch.column(c).slice(at, 128).to_pylist() for c in (0, 1)))
                if current.chars >= block:
                    yield from current.rows()
                    current, k = None, k + 1
        if current:
            yield from current.rows()

    enc = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                  .mapInArrow(encode, _ENCODED), "aligned")
    pairs = enc.filter("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b", "c")).alias("at", "p")) \
        .select("block", "at", "p.a", "p.b", "p.c")
    totals = written(pairs.groupBy("a", "b").agg(F.sum("c").alias("n")), "pair_counts")
    scored = totals.join(totals.groupBy("a").agg(F.max("n").alias("most")), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    back = pairs.join(scored, ["a", "b"]).select(F.col("block").alias("held_in"), "at", "n", "best")

    def sums(docs: pa.Table, counts: pa.Table) -> pa.Table:
        of_block = docs.filter(pc.is_valid(docs["a"])).slice(0, 1).to_pylist()[0] if docs.num_rows else {}
        rows = docs.filter(pc.is_null(docs["a"]))
        count, best = np.zeros(len(of_block.get("a", ())) + 1, np.int64), np.zeros(len(of_block.get("a", ())) + 1, np.int64)  # the last for pairs of rejected texts
        place = counts["at"].to_numpy()
        count[place], best[place] = counts["n"].to_numpy(), counts["best"].to_numpy()
        starts, held = (np.array(of_block.get(k) or [0], np.int64) for k in ("unit_starts", "unit_pairs"))
        per_unit = [np.diff(np.concatenate([[0], np.cumsum(x[held])])[starts]) if len(starts) > 1 else np.zeros(0, np.int64) for x in (best, count)]
        units = rows["units"].combine_chunks()
        ends = units.offsets.to_numpy()
        flat = units.values.to_numpy(zero_copy_only=False)
        n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(x[flat])])[ends]) for x in per_unit)
        out = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return out.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)) \
            .append_column("groups_sha256", rows["groups_sha256"])

    return enc.groupBy("block").cogroup(back.groupBy("held_in")).applyInArrow(
        sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
