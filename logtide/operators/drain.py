"""Template mining by Drain (He et al. 2017), one leaf of its prefix tree at a time.

Messages are masked, and their distinct masked forms are routed by their number of tokens and
their first token (digits, and tokens beyond a node's children, go to ``<*>``).  A leaf's
clusters meet no others, so leaves are mined in parallel; within a leaf, forms come in the
order of first appearance: each joins the cluster that shares most tokens, or opens one, and
tokens in which it differs become ``<*>``.  A leaf compares forms with a limited number of
clusters: where one more opens, the one that was joined longest ago is closed.  It keeps its
records and its text, but takes no more; so no form joins a cluster that it isn't like.

A form that comes again keeps its first cluster.  With ``strict``, each record is looked at
anew, in order, as if the miner read one record after the other; leaves are still mined in
parallel, but a leaf's records go through one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.functions.text import MASKS, masked
from logtide.operators.ordering import attached, written
from logtide.operators.shipping import ship

ANY = "<*>"
EMPTY = "<EMPTY>"
SIMILARITY = 0.4
MOST_CHILDREN = 100
MOST_CLUSTERS = 2048
#: What Python's split() takes for white space, and what it doesn't, for Java.  Single characters below 256 cost least to look for.
_ODD = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0"
_BLANKS = rf" {_ODD}\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACES, TOKEN = f"[{_BLANKS}]+", f"[^{_BLANKS}]"
#: At least all white space but the space, in few ranges.
MAYBE_ODD = rf"[{_ODD}\u1680-\u200A\u2028-\u3000]"
#: Forms that are compared with a leaf's clusters at once, and clusters that a task gives back at once.
BATCH_FORMS, BATCH = 64, 1000
#: Tokens that a leaf keeps numbers of, beyond those in its clusters.
MOST_NAMES = 1 << 16
#: Bytes of distinct forms up to which what was found of them is broadcast to the records; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Settings:
    """How messages are masked, routed and joined to clusters."""

    similarity: float = SIMILARITY
    most_children: int = MOST_CHILDREN
    most_clusters: int = MOST_CLUSTERS
    strict: bool = False
    masks: tuple[tuple[str, str], ...] = MASKS


class _Numbers(dict):
    """Numbers of tokens, by first appearance; 0 is ``<*>``."""

    def __init__(self, names: Iterable[str] = ()):
        self.names: list[str] = []
        for name in [ANY, *names]:
            self[name]

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        self.names.append(token)
        return number


class Leaf:
    """Clusters of token lists of one length, as tables of numbered tokens that are compared at once.

    Forms come in batches.  ``marks`` has a byte of each token's number; these bytes tell for a whole
    batch how many places a form can share at most with a cluster, or with a form before it
    (clusters only lose tokens).  Only what may be like enough is compared by its numbers, form by form.
    """

    def __init__(self, size: int, settings: Settings = Settings()):
        import numpy as np

        self.size, self.settings, self.count, self.opened = size, settings, 0, 0
        #: By row of the table: the cluster's number, its wildcards and its weight.  Then numbers, texts and weights of closed clusters.
        self.ids, self.wild, self.weight = (np.zeros(8, np.int64) for _ in range(3))
        self.closed: list[tuple[int, str, int]] = []
        self.numbers = _Numbers()
        self.table, self.marks = np.zeros((8, size), np.int32), np.zeros((size, 8), np.uint8)
        #: Rows, those that were joined longest ago first.
        self.joined: dict[int, None] = {}
        #: Places that a form must share with a cluster to join it.
        self.least = next((k for k in range(size + 1) if k / size >= settings.similarity), size + 1)

    def add(self, tokens: list[str]) -> int:
        return self.add_all([tokens], [1])[0]

    def add_all(self, forms: list[list[str]], weights: list[int]) -> list[int]:
        """The clusters' numbers of a batch of forms, which come one after the other."""
        import numpy as np

        if len(self.numbers) > MOST_NAMES + 2 * self.table.size:
            self.forget()
        n, before = len(forms), self.count
        while len(self.ids) < min(before + n, self.settings.most_clusters):
            self.ids, self.wild, self.weight, self.table = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.wild, self.weight, self.table))
            self.marks = np.concatenate([self.marks, np.zeros_like(self.marks)], axis=1)
        own = np.array([list(map(self.numbers.__getitem__, tokens)) for tokens in forms], np.int32)
        near, starts = self.near(own)
        # Rows of the clusters that the columns of ``near`` stand for: those of before, and those that the batch's forms open.
        rows = np.concatenate([np.arange(before), np.full(n, -1)])
        column = dict(enumerate(range(before)))
        out, changed = [], set()
        for i in range(n):
            at = self.best(own[i], rows[near[starts[i] : starts[i + 1]]]) if starts[i] < starts[i + 1] else None
            if at is not None:
                self.table[at, self.table[at] != own[i]] = 0
                self.wild[at] = self.size - np.count_nonzero(self.table[at])
                self.weight[at] += weights[i]
                del self.joined[at]
            else:
                if self.count >= self.settings.most_clusters:
                    at = next(iter(self.joined))
                    self.closed.append(self.cluster(at))
                    del self.joined[at]
                    rows[column[at]] = -1
                else:
                    at = self.count
                    self.count += 1
                self.table[at], self.ids[at], self.weight[at] = own[i], self.opened, weights[i]
                self.wild[at] = self.size - np.count_nonzero(own[i])
                self.opened += 1
                rows[before + i], column[at] = at, before + i
            self.joined[at] = None
            changed.add(at)
            out.append(int(self.ids[at]))
        at = list(changed)
        self.marks[:, at] = _marks(self.table[at]).T
        return out

    def near(self, own) -> tuple:
        """Of each form of a batch, the clusters and earlier forms (numbered after the clusters) that it may be like; where those of each form begin."""
        import numpy as np

        n, marks = len(own), _marks(own)
        columns = np.concatenate([self.marks[:, : self.count], marks.T], axis=1)
        # A cluster's <*> has the mark 0, a form's own one no mark at all: they aren't shared.
        sought = np.where(own == 0, np.uint8(255), marks).T[:, :, None]
        most = np.zeros((n, columns.shape[1]), np.uint8 if self.size < 256 else np.int32)
        equal = np.empty(most.shape, bool)
        for column, form in zip(columns, sought, strict=True):
            np.equal(column, form, out=equal)
            np.add(most, equal.view(np.uint8), out=most)
        near = most >= self.least
        near[:, self.count :] &= np.tri(n, k=-1, dtype=bool)
        found, at = np.nonzero(near)
        return at, np.searchsorted(found, np.arange(n + 1)).tolist()

    def best(self, own, rows) -> int | None:
        """The row of ``rows`` (-1: none any more) that a form joins."""
        import numpy as np

        rows = rows[rows >= 0]
        if not len(rows):
            return None
        cells = self.table[rows]
        same = ((cells == own) & (cells != 0)).sum(axis=1)
        # Of clusters that share as many tokens, the one with more wildcards, then the older one.
        likeness = same * (self.size + 1) + self.wild[rows]
        equal = np.flatnonzero(likeness == likeness.max())
        best = equal[np.argmin(self.ids[rows[equal]])]
        return int(rows[best]) if same[best] >= self.least else None

    def forget(self) -> None:
        """Numbers anew, without the tokens that are in no cluster any more."""
        import numpy as np

        live = np.union1d([0], self.table[: self.count])
        self.numbers = _Numbers(self.numbers.names[i] for i in live[1:])
        self.table[: self.count] = np.searchsorted(live, self.table[: self.count])
        self.marks[:, : self.count] = _marks(self.table[: self.count]).T

    def cluster(self, at: int) -> tuple[int, str, int]:
        return int(self.ids[at]), " ".join(map(self.numbers.names.__getitem__, self.table[at].tolist())), int(self.weight[at])

    def take_closed(self) -> list[tuple[int, str, int]]:
        out, self.closed = self.closed, []
        return out

    def clusters(self) -> list[tuple[int, str, int]]:
        """Numbers, texts and weights of the clusters that haven't been taken."""
        return self.take_closed() + [self.cluster(i) for i in range(self.count)]


def _marks(numbers):
    """1 to 254 by number, 0 for ``<*>``."""
    import numpy as np

    return np.where(numbers == 0, 0, numbers % 254 + 1).astype(np.uint8)


def form_of(message: str, settings: Settings) -> Column:
    text = F.trim(F.col(message))
    return masked(F.when(text.rlike(TOKEN), text).otherwise(EMPTY), settings.masks)


def forms_of(formed: DataFrame, order: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """From records with their masked message ``form``: the distinct ones with first (their first place in the order), n (their records) and the leaf that they are routed to."""
    forms = formed.select("form", F.struct(*order).alias("_at")).groupBy("form").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    # Tokens are what Python's split() gives; blanks around them make none.  Most texts have single spaces only, at which it costs least to split.
    forms = forms.withColumn("_tokens", F.when(F.col("form").rlike(MAYBE_ODD) | F.col("form").contains("  "), F.split("form", SPACES)).otherwise(F.split("form", " ")))
    forms = forms.withColumn("_blank", (F.get("_tokens", F.lit(0)) == "").cast("int"))
    forms = forms.withColumn("size", F.size("_tokens") - F.col("_blank") - (F.element_at("_tokens", -1) == "").cast("int")).withColumn("_token", F.get("_tokens", "_blank"))
    # Written, since it is read twice below.
    forms = written(forms.drop("_tokens", "_blank"), "drain-distinct")
    # A node's children are its first tokens by appearance; the last place is that of <*>.
    heads = forms.where(~F.col("_token").rlike("[0-9]")).groupBy("size", "_token").agg(F.min("first").alias("_first"))
    own = heads.withColumn("_n", F.row_number().over(Window.partitionBy("size").orderBy("_first"))).where(F.col("_n") < settings.most_children).select("size", "_token", F.col("_token").alias("_own"))
    own = written(own, "drain-heads")
    # Few, unless messages have very many lengths.
    if (own.agg(F.sum(F.octet_length("_token") * 2 + 100)).first()[0] or 0) <= BROADCAST_BYTES:
        own = F.broadcast(own)
    return forms.join(own, ["size", "_token"], "left").select("form", "first", "n", "size", F.coalesce("_own", F.lit(ANY)).alias("leaf"))


def _mine(settings: Settings, names_only: bool = False):
    """A function for mapInArrow: rows (size, leaf, form, n, what goes along) in order, to (what goes along, template_key, null, n), without ``names_only``, and of each cluster (null, template_key, template, the sum of its n)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, leaf, ended, row = None, None, [], None

        def texts():
            for i in range(0, len(ended), BATCH):
                keys, names, sums = zip(*ended[i : i + BATCH], strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), row), pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(sums, pa.int64())], names=["row", "template_key", "template", "n"])
            ended.clear()

        for batch in batches:
            row, keys = batch.column(4).type, []
            sizes, names, forms, weights = (batch.column(i).to_pylist() for i in range(4))
            i = 0
            while i < len(forms):
                if (sizes[i], names[i]) != at:
                    if at is not None:
                        ended += [(f"{at[0]} {at[1]} {k}", text, n) for k, text, n in leaf.clusters()]
                    at = sizes[i], names[i]
                    leaf = Leaf(sizes[i], settings)
                end = i + 1
                while end < min(i + BATCH_FORMS, len(forms)) and (sizes[end], names[end]) == at:
                    end += 1
                found = leaf.add_all([form.split() for form in forms[i:end]], weights[i:end])
                if not names_only:
                    keys += [f"{at[0]} {at[1]} {k}" for k in found]
                i = end
            if leaf is not None:
                ended += [(f"{at[0]} {at[1]} {k}", text, n) for k, text, n in leaf.take_closed()]
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(keys, pa.string()), pa.nulls(len(keys), pa.string()), batch.column(3)], names=["row", "template_key", "template", "n"])
            yield from texts()
        if at is not None:
            ended += [(f"{at[0]} {at[1]} {k}", text, n) for k, text, n in leaf.clusters()]
            yield from texts()

    return run


def _dealt(routed: DataFrame, first: str) -> DataFrame:
    """Rows for ``_mine``: by leaf, in order."""
    return routed.repartition("size", "leaf").sortWithinPartitions("size", "leaf", first).select("size", "leaf", "form", "n", "row")


def counted(records: DataFrame, order: Sequence[str], message: str = "message", settings: Settings = Settings()) -> DataFrame:
    """(template, n): the templates that ``mine`` finds and their records, without a look back at the records.

    Clusters of the same text are one template.
    """
    ship(records.sparkSession)
    formed = records.withColumn("form", form_of(message, settings))
    if settings.strict:
        formed = written(formed.select("form", *order), "drain-formed")
        forms = written(forms_of(formed, order, settings), "drain-forms")
        routed = attached(formed.select("form", F.struct(*order).alias("first")), forms.drop("first"), "form", "n").withColumn("n", F.lit(1).cast("long"))
    else:
        routed = forms_of(formed, order, settings)
    mined = _dealt(routed.withColumn("row", F.lit(None).cast("int")), "first").mapInArrow(_mine(settings, names_only=True), "row int, template_key string, template string, n long")
    return mined.groupBy("template").agg(F.sum("n").alias("n"))


def mine(records: DataFrame, order: Sequence[str], message: str = "message", settings: Settings = Settings()) -> DataFrame:
    """``records`` with template_key and template, the final text of its cluster.

    Only distinct forms are dealt out by leaf; the records are joined to what is found, the
    most frequent forms by broadcast.  ``strict``: the records themselves are dealt out;
    ``order`` must tell them apart.
    """
    ship(records.sparkSession)
    # Masking costs more than anything else, so it is done once.
    formed = written(records.withColumn("form", form_of(message, settings)), "drain-formed")
    forms = written(forms_of(formed, order, settings), "drain-forms")
    if settings.strict:
        routed = attached(formed.select("form", F.struct(*order).alias("row")), forms.drop("first"), "form", "n").withColumn("n", F.lit(1).cast("long"))
    else:
        routed = forms.withColumn("row", F.col("form"))
    dealt = _dealt(routed, "row" if settings.strict else "first")
    kind = dealt.schema["row"].dataType.simpleString()
    mined = written(dealt.mapInArrow(_mine(settings), f"row {kind}, template_key string, template string, n long"), "drain-mined")
    found = mined.where("row IS NOT NULL").select("row", "template_key", "n")
    names = mined.where("row IS NULL").select("template_key", "template", F.col("n").alias("_n"))
    if not settings.strict and (forms.agg(F.sum(F.octet_length("form") * 3 + 100)).first()[0] or 0) <= BROADCAST_BYTES:
        named = found.join(F.broadcast(names.drop("_n")), "template_key").withColumnRenamed("row", "form").drop("n")
        return formed.join(F.broadcast(named), "form").drop("form")
    # One row a cluster; a cluster may have most of the rows.
    named = attached(found, names, "template_key", "_n").drop("_n")
    if settings.strict:
        same = [F.col(c) == F.col(f"row.{c}") for c in order]
        return formed.drop("form").join(named.drop("n"), same).drop("row")
    named = written(named.withColumnRenamed("row", "form"), "drain-named")
    return attached(formed, named, "form", "n").drop("form", "n")
