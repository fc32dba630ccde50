"""Reading, checking and cleaning a snapshot of token records."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.functions.documents import canonical_json
from twinledger.functions.text import normalize_name, normalize_url, token_order
from twinledger.identity import tidy_address, tidy_chain
from twinledger.runtime import land, spread

KEY = ["chain", "contract_address", "token_id"]
#: columns beside the key that a dimension needs
DIMENSIONS = {"name": "name_norm", "token_uri": "token_uri_norm", "image_uri": "image_uri_norm", "metadata": "metadata_json"}


@dataclass(frozen=True)
class ReadOptions:
    """chains: only these (all if empty). dimensions: which columns to read beside the key. order: the column that gives source order.
    tidy_chains: the chain column is tidy already, see clean."""

    chains: Sequence[str] = ()
    dimensions: Sequence[str] = tuple(DIMENSIONS)
    order: str | None = None
    tidy_chains: bool = False


def validate(df: DataFrame, options: ReadOptions = ReadOptions()) -> DataFrame:
    """The needed columns cast to text; raises ValueError for missing ones or types that have no text form. Others are ignored."""
    wanted = [*KEY, *(DIMENSIONS[d] for d in options.dimensions)]
    missing = [c for c in [*wanted, *([options.order] if options.order else [])] if c not in df.columns]
    nested = [c for c in wanted if c in df.columns and df.schema[c].dataType.typeName() in ("array", "map", "struct", "binary")]
    if missing or nested:
        raise ValueError(f"missing columns {missing}, columns without a text form {nested}")
    return df.select(*(F.col(c).cast("string") for c in wanted), *([F.col(options.order).alias("source_order")] if options.order else []))


def read_snapshot(spark: SparkSession, paths: str | Iterable[str], options: ReadOptions = ReadOptions()) -> DataFrame:
    """Rows of Parquet snapshots, cleaned: see clean. Columns of unused dimensions and rows of other chains are not read.

    Without an order column the order is that of files by name and rows within; it is then computed from file name and row index.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*files)
    if options.order is None:
        df = df.withColumn("source_order", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
        options = replace(options, order="source_order")
    return clean(validate(df, options), options.chains, options.tidy_chains)


def clean(rows: DataFrame, chains: Sequence[str] = (), tidy_chains: bool = False) -> DataFrame:
    """Tidied keys, nulls as empty text, metadata trimmed; rows without chain, address or token are dropped.

    chains are compared tidied, which no scan can prune by. With tidy_chains the caller promises that the chain column holds tidy names only, as
    snapshots that `sinks.write_snapshot` wrote do; then the raw column is filtered too, which prunes their folders or row groups.
    """
    if chains and tidy_chains:
        rows = rows.filter(F.col("chain").isin([c.strip().lower() for c in chains]))
    tidy = rows.withColumns({
        "chain": F.coalesce(tidy_chain(F.col("chain")), F.lit("")),
        "contract_address": F.coalesce(tidy_address(F.col("chain"), F.col("contract_address")), F.lit("")),
        "token_id": F.coalesce(F.trim("token_id"), F.lit("")),
        **{c: F.coalesce(F.trim(c) if c == "metadata_json" else F.col(c), F.lit("")) for c in DIMENSIONS.values() if c in rows.columns},
    })
    kept = tidy.filter((F.col("chain") != "") & (F.col("contract_address") != "") & (F.col("token_id") != ""))
    return kept.filter(F.col("chain").isin([c.strip().lower() for c in chains])) if chains else kept


def _first(column: str, present) -> F.Column:
    """The first present value in source order."""
    return F.min(F.when(present, F.struct("source_order", F.col(column))))[column]


def tokens(rows: DataFrame) -> DataFrame:
    """One row per token of cleaned rows: the first non-blank name and the first non-empty URIs in source order (empty if none)."""
    out = []
    for c in ("name_norm", "token_uri_norm", "image_uri_norm"):
        if c in rows.columns:
            present = F.trim(c) != "" if c == "name_norm" else F.col(c) != ""
            out.append(F.coalesce(_first(c, present), F.lit("")).alias(c))
    return rows.groupBy(*KEY).agg(F.min("source_order").alias("source_order"), *out)


def uri_conflicts(rows: DataFrame) -> DataFrame:
    """Tokens with several different non-empty URIs in one column: key, field_name, uris. A strict load refuses a snapshot that has any."""
    found = []
    for c in ("token_uri_norm", "image_uri_norm"):
        if c in rows.columns:
            own = rows.filter(F.col(c) != "").groupBy(*KEY).agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.countDistinct(c).alias("uris"))
            found.append(own.filter("lo <> hi").select(*KEY, F.lit(c).alias("field_name"), "uris"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def refuse_conflicts(rows: DataFrame) -> DataFrame:
    """The rows, unless uri_conflicts finds any: then ValueError."""
    bad = uri_conflicts(rows).take(3)
    if bad:
        raise ValueError(f"tokens with several URIs, for example {bad}")
    return rows


def chain_totals(rows: DataFrame) -> DataFrame:
    """(chain, contracts, nfts): the denominators of every ratio. Distinct tokens first, so that no distinct count holds a set."""
    each = rows.select(*KEY).distinct().groupBy("chain", "contract_address").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("chain").agg(F.count(F.lit(1)).alias("contracts"), F.sum("n").alias("nfts"))


def anchors(rows: DataFrame, normalised: bool = True, keep: int | None = None, highest: bool = False) -> DataFrame:
    """(key, source_order, document): the first valid canonical metadata of each token in source order.

    keep, highest: see bounded. rows: a scan, see runtime.spread.
    """
    valid = spread(rows.filter("metadata_json <> ''")).withColumn("document", canonical_json(F.col("metadata_json"), normalised)).filter(F.col("document").isNotNull())
    first = valid.groupBy(*KEY).agg(F.min(F.struct("source_order", "document")).alias("f")).select(*KEY, "f.*")
    return first if keep is None else bounded(first, keep, highest)


def bounded(found: DataFrame, keep: int, highest: bool = False) -> DataFrame:
    """Of anchors only ``keep`` tokens per contract, in ascending order of token ids, or descending with highest.

    Spark keeps the best rows of each task before they move (a window group limit), so a contract with most tokens sends ``keep`` rows per task.
    """
    order = token_order(F.col("token_id"))
    by = Window.partitionBy("chain", "contract_address").orderBy(*([order.desc(), F.col("token_id").desc()] if highest else [order, F.col("token_id")]))
    return found.withColumn("__rank", F.row_number().over(by)).filter(F.col("__rank") <= keep).drop("__rank")


def first_texts(rows: DataFrame) -> DataFrame:
    """(key, source_order, document): the first metadata of each token as it is, in lower case; for documents that need no canonical form."""
    given = rows.filter("metadata_json <> ''").select(*KEY, "source_order", F.lower("metadata_json").alias("document"))
    return given.groupBy(*KEY).agg(F.min(F.struct("source_order", "document")).alias("f")).select(*KEY, "f.*")


def keyed_texts(rows: DataFrame, key_of: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """first_texts in two: (key, doc), what key_of makes of each token's first text, and (document), the texts of all rows. rows: a scan, as it is
    read for each; so no text moves with the tokens."""
    given = rows.filter("metadata_json <> ''").select(*KEY, "source_order", F.lower("metadata_json").alias("document"))
    first = given.select(*KEY, "source_order", key_of(F.col("document")).alias("doc")).groupBy(*KEY).agg(F.min(F.struct("source_order", "doc")).alias("f"))
    return first.select(*KEY, "f.doc"), given.select("document")


def seed_anchors(rows: DataFrame, seeds: DataFrame, normalised: bool = True) -> DataFrame:
    """The anchors (see anchors) that can matter to a comparison with seeds (chain, contract_address), of a landed table of cleaned rows.

    Metadata is parsed only of rows of the seeds' contracts, of rows with a token id that a seed has, and of each other contract's highest
    token; where that has no valid document, of all rows of its contract. What is left out can neither be aligned with a seed's token
    nor be its contract's highest.
    """
    key = ["chain", "contract_address"]
    given = rows.filter("metadata_json <> ''")
    mine = land(seeds.select(*key).distinct(), "seeds")
    shared = given.join(mine, key, "left_semi").select("token_id").distinct().withColumn("shared", F.lit(True))
    top = given.groupBy(*key).agg(F.max(F.struct(token_order(F.col("token_id")), "token_id")).alias("t")).select(*key, F.col("t.token_id").alias("top"))
    flagged = given.join(mine.withColumn("mine", F.lit(True)), key, "left").join(shared, "token_id", "left").join(top, key)
    flagged = land(flagged.withColumn("matters", F.coalesce(F.col("mine"), F.lit(False)) | F.coalesce("shared", F.lit(False))).select(*rows.columns, "matters", (F.col("token_id") == F.col("top")).alias("highest")), "flagged")
    first = land(anchors(flagged.filter("matters or highest").select(*rows.columns), normalised), "anchors")
    topped = first.join(flagged.filter("highest").select(*KEY).distinct(), KEY, "left_semi").select(*key).distinct()
    rest = flagged.filter("not matters and not highest").join(topped, key, "left_anti")
    return first.unionByName(anchors(land(rest.select(*rows.columns), "rest"), normalised))


def seed_contracts(seeds: DataFrame) -> DataFrame:
    """(chain, contract_address) of every row of a table of seeds (chain, address) that has both."""
    tidy = seeds.select(tidy_chain(F.col("chain")).alias("chain"), tidy_address(F.col("chain"), F.col("address")).alias("contract_address"))
    return tidy.filter("chain <> '' and contract_address is not null").distinct()


def identities(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """(chain, contract_address, token_id, source_order) of the tokens of some contracts (chain, contract_address) only, as a cached run needs them; no other
    column is read."""
    return rows.select(*KEY, "source_order").join(contracts.select("chain", "contract_address").distinct(), ["chain", "contract_address"], "left_semi").groupBy(*KEY).agg(F.min("source_order").alias("source_order"))


def exported(assets: DataFrame, names: bool = True) -> DataFrame:
    """The eleven text columns of a snapshot from collected assets; nulls become empty text, URIs and names get their normal forms."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = F.coalesce(normalize_name(F.col("asset_name")), F.lit("")) if names else text("asset_name")
    return assets.select(
        tidy_chain(F.col("chain")).alias("chain"), F.coalesce(tidy_address(F.col("chain"), F.col("contract_address")), F.lit("")).alias("contract_address"), text("token_id").alias("token_id"),
        text("token_uri").alias("token_uri"), text("image_uri").alias("image_uri"), text("asset_name").alias("name"), text("symbol").alias("symbol"), text("metadata").alias("metadata_json"),
        normalize_url(F.col("token_uri")).alias("token_uri_norm"), normalize_url(F.col("image_uri")).alias("image_uri_norm"), name.alias("name_norm"),
    )


def in_blocks(rows: DataFrame, first: int, last: int, column: str = "first_seen_block") -> DataFrame:
    """Rows of an inclusive range of blocks; null blocks are out. A plain comparison, so that scans and databases prune by it."""
    if first < 0 or first > last:
        raise ValueError(f"no block range: {(first, last)}")
    return rows.filter(F.col(column).between(first, last))


def metadata_column(columns: Sequence[str]) -> str:
    """The column that holds metadata: ``raw_metadata`` where a table has it, else ``metadata``; ValueError if it has neither."""
    found = [c for c in ("raw_metadata", "metadata") if c in {x.lower() for x in columns}]
    if not found:
        raise ValueError("no column with metadata")
    return found[0]


def jdbc_options(url: str, table: str, columns: Sequence[str], id_column: str = "id", blocks: tuple[int, int] | None = None, fetch_rows: int = 100_000, partitions: int = 1, bounds: tuple[int, int] | None = None, text_type: str = "TEXT", **more: str) -> dict[str, str]:
    """Options of Spark's JDBC reader for an asset table; ``raw_metadata`` is read as metadata where the table has it.

    Text casts happen in the database, as token ids exceed any numeric type; text_type is its name for long texts. blocks: an inclusive range
    of first_seen_block. more: further options of the reader, such as user, driver or sessionInitStatement.
    """
    metadata = metadata_column(columns)
    if blocks and (blocks[0] < 0 or blocks[0] > blocks[1]):
        raise ValueError(f"no block range: {blocks}")
    where = f" WHERE first_seen_block BETWEEN {int(blocks[0])} AND {int(blocks[1])}" if blocks else ""
    known = {c.lower() for c in columns}
    plain = [c for c in ("contract_address", "token_uri", "image_uri", "name", "symbol") if c in known]
    query = f"SELECT {id_column}, CAST(token_id AS {text_type}) AS token_id, {', '.join(plain)}, CAST({metadata} AS {text_type}) AS metadata FROM {table}{where}"
    options = {"url": url, "dbtable": f"({query}) AS assets", "fetchsize": str(fetch_rows)} | more
    if partitions > 1 and bounds:
        options |= {"partitionColumn": id_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return options


def read_assets(spark: SparkSession, url: str, table: str, chain: str, id_column: str = "id", isolation: str | None = None, **options) -> DataFrame:
    """Assets of one chain's table of a database, as `exported` takes them, with the table's id as source_order.

    The columns are looked up first; missing ones are null. isolation: a statement that opens each connection's transaction, such as the
    database's for a repeatable read. One partition reads one snapshot; several (see jdbc_options) read one each, so they need a table that
    is not written meanwhile.
    """
    more = {k: v for k, v in options.items() if k in ("user", "password", "driver", "queryTimeout")}
    probe = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT * FROM {table} WHERE 1 = 0) AS probe", **more).load()
    session = {"sessionInitStatement": isolation} if isolation else {}
    rows = spark.read.format("jdbc").options(**jdbc_options(url, table, probe.columns, id_column, **options, **session)).load()
    rows = rows.toDF(*(c.lower() for c in rows.columns))
    text = lambda c, to=None: (F.col(c) if c in rows.columns else F.lit(None).cast("string")).cast("string").alias(to or c)
    return rows.select(F.col(id_column.lower()).alias("source_order"), F.lit(chain).alias("chain"), text("contract_address"), text("token_id"), text("token_uri"), text("image_uri"), text("name", "asset_name"), text("symbol"), text("metadata"))
