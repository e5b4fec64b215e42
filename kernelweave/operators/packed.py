"""Graphs as bytes, many in a row, and the refinement of their labels in numpy. A label is an md5 as two numbers, which sort as
its text does; its text is made only to be hashed again or to be returned."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_graphs

#: A label's first byte says where it is counted.
BUCKETS = 256


def _pack(numbers) -> bytes:
    """Unsigned numbers, in as few bytes each as the largest needs; the first byte says how many."""
    import numpy as np

    kind = np.min_scalar_type(int(numbers.max()) if len(numbers) else 0)
    return bytes([kind.itemsize]) + numbers.astype(kind.newbyteorder("<")).tobytes()


def _unpack(data: bytes):
    import numpy as np

    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def packed_graphs(inc: DataFrame, least: int) -> DataFrame:
    """Rows of whole graphs of ``least`` members or more: ids, numbers of vertices and hyperedges of each graph, degrees, sizes,
    and members in the order of hyperedges as places in their graph. Rows of ``inc`` may be repeated.

    Degrees and sizes count all rows of a graph; members are those that equality joins find, so with no id that is null, and
    hyperedges without any are left out.
    """
    kind = dict(inc.dtypes)["gid"]

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def codes(column):
            return pc.dictionary_encode(column.combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)

        def places(own):
            _, first, inverse = np.unique(graph * (own.max() + 1) + own, return_index=True, return_inverse=True)
            return first, inverse

        null = {c: pc.is_null(table[c]).to_numpy(zero_copy_only=False) for c in ("eid", "vid")}
        missing = table["missing"].to_numpy(zero_copy_only=False).astype(bool)
        _, g_first, graph = np.unique(codes(table["gid"]) * 2 + missing, return_index=True, return_inverse=True)
        (e_first, e), (v_first, v) = places(codes(table["eid"])), places(codes(table["vid"]))
        once = np.unique(e * len(v_first) + v)
        e, v = once // len(v_first), once % len(v_first)
        degrees, sizes = np.bincount(v), np.bincount(e)
        no_graph = missing[g_first]
        found = ~(no_graph[graph[e_first]] | null["eid"][e_first])[e] & ~null["vid"][v_first][v]
        e, v = e[found], v[found]
        counts = np.bincount(e, minlength=len(e_first))
        kept = counts > 0
        n_v, n_e = (np.bincount(x, minlength=len(g_first)) for x in (graph[v_first], graph[e_first][kept]))
        members = v - (np.cumsum(n_v) - n_v)[graph[v_first][v]]
        gids = table["gid"].combine_chunks().take(pa.array(g_first))
        gids = pc.if_else(pa.array(no_graph), pa.scalar(None, gids.type), gids)
        row = {"n_v": n_v, "n_e": n_e, "degrees": degrees, "sizes": sizes[kept], "counts": counts[kept], "members": members}
        yield pa.RecordBatch.from_pydict({"gids": pa.ListArray.from_arrays(pa.array([0, len(gids)], pa.int32()), gids)} | {k: pa.array([_pack(x)], pa.binary()) for k, x in row.items()})

    # whole_graphs compares ids, which nulls would not bear
    gid = F.coalesce("gid", F.lit("0").cast(kind))
    rows = inc.select(gid.alias("gid"), "eid", "vid", F.col("gid").isNull().alias("missing"))
    return whole_graphs(rows, run, f"gids array<{kind}>, n_v binary, n_e binary, degrees binary, sizes binary, counts binary, members binary", least)


def _hashed(texts) -> list:
    """Labels of texts."""
    import numpy as np

    try:
        from _md5 import md5  # the same without OpenSSL's overhead for short texts
    except ImportError:
        from hashlib import md5

    return np.frombuffer(b"".join([md5(x).digest() for x in texts]), ">u8").astype(np.uint64).reshape(-1, 2)


def _hex(labels):
    """Labels' texts, 32 bytes in each row."""
    import numpy as np

    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    own = np.frombuffer(labels.astype(">u8").tobytes(), np.uint8).reshape(-1, 16)
    return np.stack([digits[own >> 4], digits[own & 15]], axis=2).reshape(-1, 32)


def pair_bytes(labels):
    """Labels' texts as an Arrow array of strings."""
    import numpy as np
    import pyarrow as pa

    at = np.arange(len(labels) + 1, dtype=np.int32) * 32
    return pa.StringArray.from_buffers(len(labels), pa.py_buffer(at.tobytes()), pa.py_buffer(_hex(labels).tobytes()))


def _ranked(labels) -> tuple:
    """The distinct labels in order, and each label's place among them."""
    import numpy as np

    high, low = labels[:, 0], labels[:, 1]
    order = np.argsort(high, kind="stable")
    step = high[order][1:] != high[order][:-1]
    if not (step | (low[order][1:] == low[order][:-1])).all():
        order = np.lexsort((low, high))
        step = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    place = np.concatenate([[0], np.cumsum(step)])[: len(labels)]
    rank = np.empty(len(labels), np.int64)
    rank[order] = place
    return labels[order[np.flatnonzero(np.concatenate([[True], step])[: len(labels)])]], rank


class RefinedGraphs:
    """The graphs of one row of :func:`packed_graphs`, with the column ``chunk``, and columns ``marks1``.. for rounds whose common labels are known."""

    def __init__(self, batch, row: int) -> None:
        import numpy as np

        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        self.gids = columns["gids"][row].values
        self.chunk = columns["chunk"][row].as_py()
        self.marks = []
        while f"marks{len(self.marks) + 1}" in columns:
            self.marks.append(columns[f"marks{len(self.marks) + 1}"][row].as_py())
        n_v, n_e, degrees, self.sizes, counts, members = (_unpack(columns[c][row].as_py()) for c in ("n_v", "n_e", "degrees", "sizes", "counts", "members"))
        self.graph = np.repeat(np.arange(len(n_v)), n_v)
        self.degrees = degrees
        self.e = np.repeat(np.arange(len(counts)), counts)
        of_edge = np.repeat(np.arange(len(n_e)), n_e)
        v = members + (np.cumsum(n_v) - n_v)[of_edge[self.e]]
        met = np.zeros(len(degrees), bool)
        met[v] = True
        #: vertices that are members of something; the others have a label in round 0 only
        self.met = np.flatnonzero(met)
        self.v = (np.cumsum(met) - 1)[v]

    def _first(self, kind: bytes, numbers):
        import numpy as np

        distinct, inverse = np.unique(numbers, return_inverse=True)
        return _hashed([b"%s|%d" % (kind, x) for x in distinct.tolist()])[inverse]

    def _refined(self, kind: bytes, old, common, at, near, of):
        """New labels: of the old and the sorted labels ``near[of]`` that are ``at`` it; or, unless ``common``, copies."""
        import numpy as np

        new = np.empty_like(old)
        head = np.empty((len(old), 35), np.uint8)
        head[:, 0], head[:, 1], head[:, 34], head[:, 2:34] = ord(kind), ord("|"), ord("|"), _hex(old)
        if not common.all():
            rare = np.flatnonzero(~common)
            head[rare, 0] = ord("f")
            data = head[rare].tobytes()
            new[rare] = _hashed([data[k : k + 34] for k in range(0, len(data), 35)])
            some = common[at]
            at, of = at[some], of[some]
        kept = np.flatnonzero(common)
        if len(kept):
            _, rank = _ranked(near)
            order = np.argsort(at * len(near) + rank[of])
            text = np.full((len(of), 33), ord(","), np.uint8)
            text[:, :32] = _hex(near)[of[order]]
            text, data = text.tobytes(), head[kept].tobytes()
            ends = (np.cumsum(np.bincount(at, minlength=len(old))[kept]) * 33).tolist()
            new[kept] = _hashed([data[35 * k : 35 * k + 35] + text[a : b - 1] for k, (a, b) in enumerate(zip([0, *ends], ends))])
        return new

    def _rounds(self) -> Iterator[tuple]:
        """For round 0 and on to the round that follows the marks: labels of vertices, of hyperedges, which of both are no copies."""
        import numpy as np

        v0 = self._first(b"v", self.degrees)
        v, e = v0[self.met], self._first(b"e", self.sizes)
        go_v, go_e = np.ones(len(v), bool), np.ones(len(e), bool)
        yield v0, e, go_v, go_e
        for r in range(len(self.marks) + 1):
            if r:
                go_v, go_e = self._common(r - 1, v0 if r == 1 else None, v, e, go_v, go_e)
            e = self._refined(b"e", e, go_e, self.e, v, self.v)
            v = self._refined(b"v", v, go_v, self.v, e, self.e)
            yield v, e, go_v, go_e

    @staticmethod
    def _candidates(v0, v, e, go_v, go_e) -> tuple:
        """Labels that are counted after a round: of those that are no copies. After the first, labels of round 0 are counted too."""
        import numpy as np

        return np.concatenate([v[go_v], v0]) if v0 is not None else v[go_v], e[go_e]

    @staticmethod
    def _dealt(labels) -> tuple:
        """The distinct labels in order, each label's place among them, and where each bucket begins and ends."""
        import numpy as np

        distinct, rank = _ranked(labels)
        return distinct, rank, np.searchsorted(distinct[:, 0] >> np.uint64(56), np.arange(BUCKETS + 1).astype(np.uint64))

    def _common(self, k, v0, v, e, go_v, go_e) -> Iterator:
        """Which vertices and hyperedges have a label that the marks of a round call common."""
        import numpy as np

        for kind, labels, go in zip("ve", self._candidates(v0, v, e, go_v, go_e), (go_v, go_e)):
            distinct, rank, ends = self._dealt(labels)
            flags = np.zeros(len(distinct), bool)
            for mark in self.marks[k]:
                part = slice(ends[mark["bucket"]], ends[mark["bucket"] + 1])
                flags[part] = np.unpackbits(np.frombuffer(mark[kind], np.uint8), count=part.stop - part.start)
            out = np.zeros(len(go), bool)
            out[go] = flags[rank[: int(go.sum())]]
            yield out

    def sent(self) -> list[list[tuple]]:
        """After the round that follows the marks: for vertices and for hyperedges, each bucket's distinct labels and their counts, as bytes."""
        import numpy as np

        (v0, *_), *more = self._rounds()
        out = []
        for labels in self._candidates(None if self.marks else v0, *more[-1]):
            distinct, rank, ends = self._dealt(labels)
            data, counts = distinct.astype("<u8").tobytes(), np.bincount(rank, minlength=len(distinct)).astype("<u4").tobytes()
            out.append([(data[16 * a : 16 * b], counts[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
        return out

    def features(self, rounds: int) -> tuple:
        """Ids of graphs as an Arrow array, labels and counts: of the vertices' labels in rounds 0..rounds."""
        import numpy as np
        import pyarrow as pa

        labels, graph = [], []
        for r, (v, *_) in zip(range(rounds + 1), self._rounds()):
            labels.append(v)
            graph.append(self.graph[self.met] if r else self.graph)
        labels, graph = np.concatenate(labels), np.concatenate(graph)
        distinct, rank = _ranked(labels)
        keys, cnt = np.unique(graph * len(distinct) + rank, return_counts=True)
        return self.gids.take(pa.array(keys // len(distinct))), distinct[keys % len(distinct)], cnt


def common_labels(threshold: int) -> Callable[[Iterator], Iterator]:
    """For each row of labels that were sent to be counted, one bit for each label that is there ``threshold`` times or more, and
    whether one of the vertices' labels is. All rows of a bucket must be in one task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        buckets = table["bucket"].to_numpy()
        for bucket in np.unique(buckets):
            part = table.take(pa.array(np.flatnonzero(buckets == bucket)))
            out = {"chunk": part["chunk"].combine_chunks(), "bucket": part["bucket"].combine_chunks()}
            for kind in "ve":
                each = part[f"{kind}_lbl"].to_pylist()
                labels = np.frombuffer(b"".join(each), "<u8").astype(np.uint64).reshape(-1, 2)
                counts = np.frombuffer(b"".join(part[f"{kind}_n"].to_pylist()), "<u4").astype(np.int64)
                distinct, rank = _ranked(labels)
                total = np.zeros(len(distinct), np.int64)
                np.add.at(total, rank, counts)
                flags = (total >= threshold)[rank]
                ends = np.cumsum([len(x) // 16 for x in each]).tolist()
                own = [flags[a:b] for a, b in zip([0, *ends], ends)]
                out[kind] = pa.array([np.packbits(x).tobytes() for x in own], pa.binary())
                if kind == "v":
                    out["some"] = pa.array([bool(x.any()) for x in own])
            yield pa.RecordBatch.from_pydict({c: out[c] for c in ("chunk", "bucket", "v", "e", "some")})

    return run
