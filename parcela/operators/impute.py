"""Missing values filled from other rows of the listing, else from similar listings (problem 5).

Stage 1 carries values along the rows of a listing in time. Stage 2 factors the record-feature
cells with low-rank alternating least squares and decodes what is still missing. Every value
tells its origin. A rule that names the exact source row can't be met by a low-rank estimate,
which is why stage 1 isn't part of the factorisation.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcela.functions import text as T
from parcela.functions.listing import aviso, instant, is_missing, local_day, trimmed
from parcela.operators.units import canonical, money_udf, with_rates
from parcela.storage import materialize

FIELDS = ("m2_util", "dormitorios", "barrio")


def whole_number(text: Column) -> Column:
    """The number that begins a text as a whole number (bigint, half up); null without one.

    One mark before exactly three digits groups them; otherwise it is the decimal mark.
    """
    n = F.regexp_extract(text, r"^[\s ]*(\d+(?:[.,]\d+)*)", 1)
    grouped = n.rlike(r"^\d{1,3}([.,]\d{3})+$")
    plain = F.when(grouped, F.regexp_replace(n, "[.,]", "")).otherwise(F.regexp_replace(n, ",", "."))
    return F.round(plain.try_cast("double")).try_cast("bigint")


def field_values(row: dict[str, Column]) -> dict[str, tuple[Column, Column]]:
    """For each field its value as text (null if it holds none) and whether it is missing."""
    m2, rooms, area = row["m2_util"], row["dormitorios"], row["barrio"]
    size, number = whole_number(m2), whole_number(rooms)
    return {
        "m2_util": (F.when(size > 0, size.cast("string")), is_missing(m2) | F.coalesce(size == 0, F.lit(False))),
        "dormitorios": (F.when(~is_missing(rooms), number.cast("string")), is_missing(rooms)),
        "barrio": (F.when(~is_missing(area), F.lower(trimmed(area))), is_missing(area)),
    }


def _even_bounds(df: DataFrame, column: str, parts: int) -> list[float]:
    """Inner bounds that cut ``column`` into about ``parts`` even chunks; found by a mergeable sketch."""
    if parts < 2:
        return []
    found = df.approxQuantile(column, [k / parts for k in range(1, parts)], 0.25 / parts)
    return sorted(set(found))


def carried(rows: DataFrame, group: str, at: str, tie: str, values: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``<value>_fill`` for each column: the value of the latest earlier row of the group
    that holds one, else of the earliest later one, else null. Equal times are ordered by ``tie``.

    A group of any size is spread: the pair (group, time) is cut into even chunks, windows run in
    a chunk, and only the last and first values of the few groups that cross a chunk's border (at
    most two borders a chunk) go from chunk to chunk in a broadcast table of that bounded size.
    Rows must have ``group`` and ``at`` (integers); ``values`` may be null.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    if span.a is None:
        return rows.withColumns({f"{v}_fill": F.lit(None).cast("string") for v in values})
    # group + fraction of the time span: monotone in (group, time), which is all a cut needs
    place = F.col(group).cast("double") + (F.col(at) - F.lit(span.a)) / F.lit(float(span.b - span.a + 1))
    placed = rows.withColumn("_place", place)
    inner = _even_bounds(placed, "_place", parts)
    if inner:
        cut = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_place", outputCol="_chunk")
        placed = cut.transform(placed).withColumn("_chunk", F.col("_chunk").cast("int")).drop("_place")
    else:
        placed = placed.withColumn("_chunk", F.lit(0)).drop("_place")
    ends = sorted(tuple(r) for r in placed.groupBy("_chunk").agg(F.min(group), F.max(group)).collect())  # one row a chunk
    crossing = [a[2] for a, b in zip(ends, ends[1:]) if a[2] == b[1]]
    order = F.struct(at, tie)
    carry: list[tuple] = []
    if crossing:
        summary = placed.filter(F.col(group).isin(sorted(set(crossing)))).groupBy(group, "_chunk").agg(
            *[F.max_by(v, F.when(F.col(v).isNotNull(), order)).alias(f"{v}_last") for v in values],
            *[F.min_by(v, F.when(F.col(v).isNotNull(), order)).alias(f"{v}_first") for v in values],
        )
        by_group: dict = {}
        for r in summary.collect():  # at most two rows a chunk border
            by_group.setdefault(r[group], []).append(r)
        for key, own in by_group.items():
            own.sort(key=lambda r: r["_chunk"])
            before = [dict.fromkeys(values)]
            for r in own[:-1]:
                before.append({v: r[f"{v}_last"] if r[f"{v}_last"] is not None else before[-1][v] for v in values})
            after = [dict.fromkeys(values)]
            for r in reversed(own[1:]):
                after.append({v: r[f"{v}_first"] if r[f"{v}_first"] is not None else after[-1][v] for v in values})
            for r, b, a in zip(own, before, reversed(after)):
                carry.append((key, r["_chunk"], *[b[v] for v in values], *[a[v] for v in values]))
    kind = dict(rows.dtypes)[group]
    schema = f"{group} {kind}, _chunk int, " + ", ".join(f"`_{v}_before` string" for v in values) + ", " + ", ".join(f"`_{v}_after` string" for v in values)
    carries = spark.createDataFrame(carry, schema)
    back = W.partitionBy("_chunk", group).orderBy(F.col(at), F.col(tie)).rowsBetween(W.unboundedPreceding, -1)
    # the window that looks ahead runs backwards, as a frame that shrinks would be read anew for each row
    ahead = W.partitionBy("_chunk", group).orderBy(F.col(at).desc(), F.col(tie).desc()).rowsBetween(W.unboundedPreceding, -1)
    near = placed.withColumns({f"_{v}_prev": F.last(v, True).over(back) for v in values} | {f"_{v}_next": F.last(v, True).over(ahead) for v in values})
    joined = near.join(F.broadcast(carries), [group, "_chunk"], "left")
    filled = {f"{v}_fill": F.coalesce(f"_{v}_prev", f"_{v}_before", f"_{v}_next", f"_{v}_after") for v in values}
    return joined.select(*rows.columns, *[c.alias(n) for n, c in filled.items()])


def _listing_rows(listings: DataFrame) -> DataFrame:
    """The rows with aviso and readable time: value and missing mark of each field, narrow and written once."""
    own = field_values({f: F.col(f) for f in FIELDS})
    narrow = listings.select(
        "row_id", aviso(F.col("url_propiedad")).alias("aviso"), instant(F.col("execution_time")).alias("at"),
        *[v.alias(f) for f, (v, _) in own.items()], *[m.alias(f"{f}_falta") for f, (_, m) in own.items()],
    )
    return materialize(narrow.filter("aviso is not null and at is not null"), "listing-rows")


def filled_from_listing(listings: DataFrame) -> DataFrame:
    """``row_id``, ``campo``, ``valor`` of each missing value that another row of the same aviso holds.

    Numbers come as whole numbers, barrio in lower case without outer blanks. Rows without aviso or
    readable time neither count nor give values. No rows give none; of equal times the row of the
    smaller ``row_id`` is the earlier.
    """
    rows = carried(_listing_rows(listings), "aviso", "at", "row_id", list(FIELDS))
    each = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f"{f}_fill").alias("valor"), F.col(f"{f}_falta").alias("falta")) for f in FIELDS])
    return rows.select("row_id", F.inline(each)).filter("falta and valor is not null").select("row_id", "campo", "valor")


# --- low-rank alternating least squares -------------------------------------------------------

NUMERIC = ("m2_util", "m2_total", "dormitorios", "banios", "precio", "latitud", "longitud")
LOGGED = ("m2_util", "m2_total", "precio")
CATEGORICAL = ("tipo", "operacion", "comuna", "barrio")
#: Categories of each field with a row of their own in the factor matrix, which every task gets: the most
#: frequent. The others share ``TAIL`` rows by hash; they are evidence, but no estimate names them.
CATEGORIES, TAIL = 50_000, 1_024
#: Most pairs of a comuna and a barrio of it that are told to every task; the most frequent.
PAIRS = 200_000


def folded(c: Column) -> Column:
    """Lower case, accents off, white space collapsed: the spellings of a category as one."""
    return T.normalize_text(c)


def records(listings: DataFrame, rates: DataFrame) -> DataFrame:
    """One record for each listing (rows without aviso: for each row) with the encoded cells.

    Numbers: logarithms of sizes and prices. Categories: folded, and the barrio also as it is
    written. Of a listing's rows the most frequent value counts (of equals the least); equal rows
    hence are one record.
    """
    own = field_values({f: F.col(f) for f in FIELDS})
    number = lambda c: F.regexp_replace(trimmed(F.col(c)), ",", ".").try_cast("double")
    category = lambda c: F.when(~is_missing(F.col(c)), folded(F.col(c)))
    at = instant(F.col("execution_time"))
    used = ("row_id", "url_propiedad", "precio_uf", "m2_util", "m2_total", "dormitorios", "banios", "latitud", "longitud", "tipo_propiedad", "operacion", "comuna", "barrio")
    rows = with_rates(listings.select(*used, money_udf("precio")(F.col("precio_uf")).alias("_monto"), local_day(at).alias("fecha")), rates)
    inside = lambda c, a, b: F.when(number(c).between(a, b), number(c))
    log = lambda c: F.when(c > 0, F.log(c))
    cells = rows.select(
        F.coalesce(aviso(F.col("url_propiedad")), -F.col("row_id")).alias("registro"),
        log(own["m2_util"][0].try_cast("double")).alias("m2_util"), log(whole_number(F.col("m2_total")).cast("double")).alias("m2_total"),
        own["dormitorios"][0].try_cast("double").alias("dormitorios"), whole_number(F.col("banios")).cast("double").alias("banios"),
        log(canonical(F.col("_monto"), "UF", F.col("uf_clp"), F.col("usd_clp"))).alias("precio"),
        inside("latitud", -55, -17).alias("latitud"), inside("longitud", -109, -66).alias("longitud"),
        category("tipo_propiedad").alias("tipo"), F.regexp_replace(category("operacion"), "^en ", "").alias("operacion"), category("comuna").alias("comuna"), category("barrio").alias("barrio"),
        own["barrio"][0].alias("barrio_escrito"),
    )
    return cells.groupBy("registro").agg(*[F.mode(c, True).alias(c) for c in (*NUMERIC, *CATEGORICAL, "barrio_escrito")])


class LowRank:
    """Low-rank factors of mixed record-feature cells, by alternating least squares.

    Each record is a row of cells: standardised numbers, and one-hot groups in which the category
    counts 1 and the group's others 0 with weight ``zero``. The first factor of every record is 1,
    which gives each feature its bias. Records are solved where they lie; of them only sums of
    r x r products per feature are moved. The rank was chosen on held-out cells (README).
    """

    def __init__(self, rank: int = 12, rounds: int = 6, ridge: float = 1.0, zero: float = 0.5, seed: int = 7):
        self.rank, self.rounds, self.ridge, self.zero, self.seed = rank, rounds, ridge, zero, seed

    def fit(self, cells: DataFrame) -> LowRank:
        """``cells``: a table of ``registro``, numbers and categories that can be read again and again."""
        stats = cells.agg(*[f(c).alias(f"{n}_{c}") for c in NUMERIC for n, f in (("mean", F.mean), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]).first()
        names = []
        for c in CATEGORICAL:
            counted = cells.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"), F.mode("barrio_escrito", True).alias("w"))
            names.append([(r[c], r.w) for r in counted.orderBy(F.desc("n"), c).limit(CATEGORIES).collect()])
        pairs = cells.filter("comuna is not null and barrio is not null").groupBy("comuna", "barrio").count().orderBy(F.desc("count"), "comuna", "barrio").limit(PAIRS)
        self.prepare(stats, names, [(r.comuna, r.barrio, r["count"]) for r in pairs.collect()])
        for _ in range(self.rounds):
            self._step(cells)
        return self

    def prepare(self, stats, names: list[list[tuple]], pairs: list[tuple]) -> None:
        """The scales, the features' places and random factors. ``names``: (category, as written) by group; ``pairs``: (comuna, barrio, records)."""
        self.mean = np.array([stats[f"mean_{c}"] or 0.0 for c in NUMERIC])
        self.std = np.array([stats[f"std_{c}"] or 1.0 for c in NUMERIC])
        self.range = {c: (stats[f"min_{c}"], stats[f"max_{c}"]) for c in NUMERIC}
        self.names = [[n for n, _ in own] for own in names]
        self.written = [w for _, w in names[CATEGORICAL.index("barrio")]]
        self.index = [{n: k for k, n in enumerate(own)} for own in self.names]
        first, self.base, self.width = len(NUMERIC), [], []
        for own in self.names:
            self.base.append(first)
            self.width.append(len(own) + (TAIL if len(own) >= CATEGORIES else 0))
            first += self.width[-1]
        self.size = first
        within: dict[str, list[tuple[int, int]]] = {}
        places = self.index[CATEGORICAL.index("barrio")]
        most: dict[str, int] = {}
        for place, name, n in pairs:
            # a pair counts as valid with a twentieth of its comuna's most frequent one, as some comunas are wrong
            if name in places and n * 20 >= most.setdefault(place, n):
                within.setdefault(place, []).append((places[name], n))
        # the valid barrios of a comuna, each with its share of the comuna's records as bias
        self.within = {c: (np.array([k for k, _ in v]), np.array([n for _, n in v]) / sum(n for _, n in v)) for c, v in within.items()}
        self.factors = np.random.default_rng(self.seed).normal(0, 0.3, (self.size, self.rank))
        self.factors[: len(NUMERIC), 0] = 0

    def encode(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Standardised numbers (nan: missing) and the feature index of each category (-1: missing)."""
        x = (batch[list(NUMERIC)].to_numpy(dtype=float, na_value=np.nan) - self.mean) / self.std
        codes = []
        for g, c in enumerate(CATEGORICAL):
            known, base, n = self.index[g], self.base[g], len(self.names[g])
            tail = self.width[g] > n
            codes.append([-1 if v is None or v != v else base + k if (k := known.get(v)) is not None else base + n + zlib.crc32(v.encode()) % TAIL if tail else -1 for v in batch[c]])
        return x, np.array(codes, dtype=int).T.reshape(-1, len(CATEGORICAL))

    def solve(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The factors of records given the feature factors; the first is 1."""
        v, r = self.factors, self.rank
        grams = [self.zero * v[b : b + n].T @ v[b : b + n] for b, n in zip(self.base, self.width)]
        seen = ~np.isnan(x)
        numbers = v[: len(NUMERIC)]
        outer = np.einsum("fi,fj->fij", numbers, numbers).reshape(len(NUMERIC), -1)
        a = self.ridge * np.eye(r) + (seen.astype(float) @ outer).reshape(-1, r, r)
        b = np.where(seen, x, 0.0) @ numbers
        for g in range(len(CATEGORICAL)):
            has = codes[:, g] >= 0
            own = v[codes[has, g]]
            a[has] += grams[g] + (1 - self.zero) * (own[:, :, None] * own[:, None, :])
            b[has] += own
        u = np.ones((len(x), r))
        u[:, 1:] = np.linalg.solve(a[:, 1:, 1:], (b[:, 1:] - a[:, 1:, 0])[:, :, None])[:, :, 0]
        return u

    def sums(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """What a batch adds to the features' equations: their places, and the r x r products and right sides in a row."""
        r, n = self.rank, len(NUMERIC)
        x, codes = self.encode(batch)
        u = self.solve(x, codes)
        outer = np.concatenate([(u[:, :, None] * u[:, None, :]).reshape(len(u), r * r), u], axis=1)
        total = np.zeros((self.size + len(CATEGORICAL), r * r + r))
        seen = ~np.isnan(x)
        total[:n, : r * r] = seen.T.astype(float) @ outer[:, : r * r]
        total[:n, r * r :] = np.where(seen, x, 0.0).T @ u
        for g in range(len(CATEGORICAL)):
            has = codes[:, g] >= 0
            order = np.argsort(codes[has, g], kind="stable")
            place, first = np.unique(codes[has, g][order], return_index=True)
            if len(place):
                total[place] = np.add.reduceat(outer[has][order], first, axis=0)
                total[self.size + g] = outer[has].sum(axis=0)
        some = np.flatnonzero(total.any(axis=1))
        return some, total[some]

    def update(self, total: np.ndarray) -> None:
        """The feature factors from the summed equations."""
        r = self.rank
        gram, right = total[:, : r * r].reshape(-1, r, r), total[:, r * r :]
        a = gram[: self.size].copy()
        for g, (b, n) in enumerate(zip(self.base, self.width)):
            a[b : b + n] = (1 - self.zero) * a[b : b + n] + self.zero * gram[self.size + g]
        a += self.ridge * np.eye(r)
        self.factors = np.linalg.solve(a, right[: self.size, :, None])[:, :, 0]

    def _step(self, cells: DataFrame) -> None:
        model, width = self, self.rank * self.rank + self.rank

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    some, rows = model.sums(batch)
                    yield pd.DataFrame({"feature": some.astype("int32")} | {f"s{k}": rows[:, k] for k in range(width)})

        parts = cells.mapInPandas(part, "feature int, " + ", ".join(f"s{k} double" for k in range(width)))
        added = parts.groupBy("feature").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).toPandas()  # one row a feature
        total = np.zeros((self.size + len(CATEGORICAL), width))
        total[added["feature"].to_numpy(int)] = added[[f"s{k}" for k in range(width)]].to_numpy(float)
        self.update(total)

    def decode(self, batch: pd.DataFrame) -> pd.DataFrame:
        """For each record an estimate of each field of ``FIELDS`` as a valid value in text: numbers whole
        and within what occurs, a barrio of the record's comuna, where that is known."""
        x, codes = self.encode(batch)
        u = self.solve(x, codes)
        out: dict[str, object] = {"registro": batch["registro"].to_numpy()}
        for f in ("m2_util", "dormitorios"):
            k = NUMERIC.index(f)
            low, high = self.range[f]
            if low is None:
                out[f] = np.full(len(batch), None, dtype=object)
                continue
            value = np.clip(u @ self.factors[k] * self.std[k] + self.mean[k], low, high)
            value = np.exp(value) if f in LOGGED else value
            out[f] = np.maximum(np.rint(value), 1 if f in LOGGED else 0).astype(int).astype(str).astype(object)
        g = CATEGORICAL.index("barrio")
        own = np.array(self.written, dtype=object)
        barrio = np.full(len(batch), None, dtype=object)
        if len(own):
            block = self.factors[self.base[g] : self.base[g] + len(own)]
            place = batch["comuna"].to_numpy(dtype=object)
            for c in pd.unique(place):
                rows = np.flatnonzero(place == c) if c is not None else np.flatnonzero([p is None for p in place])
                choice, bias = self.within.get(c, (np.arange(len(own)), 0.0))
                for k in range(0, len(rows), 1024):
                    part = rows[k : k + 1024]
                    barrio[part] = own[choice[np.argmax(u[part] @ block[choice].T + bias, axis=1)]]
        out["barrio"] = barrio
        return pd.DataFrame(out)


def filled(listings: DataFrame, rates: DataFrame, model: LowRank | None = None) -> DataFrame:
    """``row_id``, ``campo``, ``valor``, ``origen`` of every missing value.

    ``origen`` is 'aviso' for a value carried from another row of the listing and 'als' for one
    estimated from similar listings. Where no record at all holds a field, its values stay missing
    and have no row. An empty table gives none.
    """
    exact = materialize(filled_from_listing(listings).withColumn("origen", F.lit("aviso")), "filled-exact")
    cells = materialize(records(listings, rates), "records")
    fitted = (model or LowRank()).fit(cells)
    estimates = cells.mapInPandas(lambda batches: (fitted.decode(b) for b in batches if len(b)), "registro long, m2_util string, dormitorios string, barrio string")
    marks = field_values({f: F.col(f) for f in FIELDS})
    missing = listings.select("row_id", F.coalesce(aviso(F.col("url_propiedad")), -F.col("row_id")).alias("registro"), *[m.alias(f"{f}_falta") for f, (_, m) in marks.items()])
    missing = missing.filter(" or ".join(f"{f}_falta" for f in FIELDS))
    each = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias("valor"), F.col(f"{f}_falta").alias("falta")) for f in FIELDS])
    guessed = missing.join(estimates, "registro").select("row_id", F.inline(each)).filter("falta and valor is not null").select("row_id", "campo", "valor")
    rest = guessed.join(exact.select("row_id", "campo"), ["row_id", "campo"], "left_anti").withColumn("origen", F.lit("als"))
    return exact.unionByName(rest)


def held_out(cells: DataFrame, share: int = 5, model: LowRank | None = None) -> DataFrame:
    """How well masked values are found again: ``campo``, ``valor`` (the masked one, in text) and
    ``estimado``. Of each field the value of every ``share``-th record by hash is masked in turn, the
    model is fitted to the rest, and the masked cells are decoded."""
    out = []
    for f in FIELDS:
        marked = cells.withColumn("_m", F.col(f).isNotNull() & (F.pmod(F.xxhash64("registro", F.lit(f)), F.lit(share)) == 0))
        masked = materialize(marked.withColumns({f: F.when(~F.col("_m"), F.col(f))} | ({"barrio_escrito": F.when(~F.col("_m"), F.col("barrio_escrito"))} if f == "barrio" else {})), "masked")
        fitted = (model or LowRank()).fit(masked)
        guess = masked.filter("_m").drop("_m").mapInPandas(lambda batches, m=fitted: (m.decode(b) for b in batches if len(b)), "registro long, m2_util string, dormitorios string, barrio string")
        true = F.round(F.exp(f)).cast("long").cast("string") if f in LOGGED else F.col(f).cast("long").cast("string") if f in NUMERIC else F.col("barrio_escrito")
        truth = marked.filter("_m").select("registro", true.alias("valor"), "comuna")
        out.append(truth.join(guess.select("registro", F.col(f).alias("estimado")), "registro").select(F.lit(f).alias("campo"), "registro", "comuna", "valor", "estimado"))
    return out[0].unionByName(out[1]).unionByName(out[2])
