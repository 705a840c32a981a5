"""Bank and order exports as landing rows. Files are read by Spark, by any path that it reads."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.exprs import strptime_to_java
from tallyframe.operators.core import first_per
from tallyframe.schemas import BRONZE, BRONZE_ORDERS, conform

from .config import IngestionError, Source


#: Records of a batch that a parser hands on.
BATCH = 8192
#: Bytes of an OFX file that are parsed at a time, and what begins a row of it, whether there are line breaks or not.
PIECE = 1 << 20
OFX_ROW = b"<STMTTRN>"


def lines_of(spark: SparkSession, path: str, end: str = "\n") -> DataFrame:
    """path and value (bytes, without the `end`) of the lines of the files at `path`: each file in one task, in the file's order.

    Files are read in splits; the shuffle that brings these together sorts on disk, so no file is ever whole in memory. Files
    compressed by gzip have one split each, so their lines are in one task and in order as they are, and aren't shuffled.
    """
    # File paths are those of URIs, where a plus sign stands for itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path")
    place = [name, F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"), F.col("value").cast("binary").alias("value")]
    files = spark.read.option("lineSep", end).text(path)
    lines = files.select(*place)
    if all(f.endswith(".gz") for f in files.inputFiles()):
        return lines.select("path", "value")
    # Partitions of a given number aren't coalesced, so files that are small as bytes aren't parsed one after the other.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(tasks, "path").sortWithinPartitions("path", "_start", "_line").select("path", "value")


def by_file(batches) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(path, its lines) of each file of Arrow batches as lines_of() has them; a file's lines are to be taken before the next file."""
    lines = ((name, value) for batch in batches for at in range(0, len(batch), BATCH) for name, value in zip(*(c.to_pylist() for c in batch.slice(at, BATCH).columns)))
    for name, group in groupby(lines, key=itemgetter(0)):
        yield name, map(itemgetter(1), group)


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of BATCH rows."""
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def csv_records(name: str, lines: Iterator[bytes], skip: int, columns: tuple, wanted: tuple | None) -> Iterator[tuple]:
    """(file, place, fields) of a CSV file's lines: a map by column, or the fields of the `wanted` columns, null where there is none."""

    def text():
        for k, line in enumerate(lines):
            line = line.decode("utf-8-sig" if not k else "utf-8")
            # Rows may end with a carriage return alone.
            yield from [line + "\n"] if "\r" not in line[:-1] else io.StringIO(line + "\n", newline="")

    def after_preamble():
        left = skip
        for line in text():
            # A preamble's lines are those of str.splitlines(), of which one of ours may have several.
            parts = line.splitlines(keepends=True) if left else ()
            gone = min(left, len(parts))
            left -= gone
            if not parts or parts[gone:]:
                yield "".join(parts[gone:]) or line

    reader = csv.reader(after_preamble())
    header = [c.strip() for c in columns or next(reader, [])]
    last = {c: k for k, c in enumerate(header)}
    at = [last.get(c) for c in wanted or ()]
    for i, row in enumerate(r for r in reader if r):
        if len(row) < len(header):
            raise ValueError(f"{name}: record {i + 1} has {len(row)} of {len(header)} fields")
        yield name, i, list(dict(zip(header, (x.strip() for x in row))).items()) if wanted is None else [None if k is None else row[k].strip() for k in at]


def records(spark: SparkSession, path: str, skip: int = 0, columns: tuple = (), wanted: tuple | None = None) -> DataFrame:
    """file_row (place in the file), and fields of each CSV record of the files at `path`: a map of column to text, or if columns are
    `wanted`, an array of their texts.

    An export is one person's statement, so a file is the unit: quoted line breaks and preambles need its lines in order. These are
    parsed as they come, a batch of records at a time. Header names and fields are stripped of outer blanks. A record with fewer
    fields than the header is an error.
    """
    kind, ddl = (pa.map_(pa.string(), pa.string()), "map<string, string>") if wanted is None else (pa.list_(pa.string()), "array<string>")
    schema = pa.schema([("path", pa.string()), ("file_row", pa.int64()), ("fields", kind)])

    def parse(batches):
        for name, lines in by_file(batches):
            yield from batched(csv_records(name, lines, skip, columns, wanted), schema)

    return lines_of(spark, path).mapInArrow(parse, f"path string, file_row long, fields {ddl}")


def signed_amount(text: Column) -> Column:
    """A money text: optional sign, also apart from the number; dollar signs and thousands commas go."""
    plain = F.regexp_replace(text, r"[$,\s]", "")
    return F.regexp_replace(plain, r"^\+", "").cast("decimal(18,2)")


def unsigned_amount(text: Column) -> Column:
    """As signed_amount without sign; a blank is 0."""
    return F.coalesce(F.abs(signed_amount(F.nullif(F.trim(text), F.lit("")))), F.lit(0).cast("decimal(18,2)"))


def row_hash(source: Column, external_id: Column, posted_on: Column, amount: Column, description: Column, occurrence: Column, scope: Column | None = None) -> Column:
    """SHA-256 of what tells a row apart: the bank's id if there is one, else content and which of equal rows it is."""
    scope = F.lit("") if scope is None else F.concat(scope, F.lit(":"))
    content = F.concat_ws("|", posted_on.cast("string"), amount.cast("string"), F.coalesce(description, F.lit("")), occurrence.cast("string"))
    return F.sha2(F.when(external_id.isNotNull(), F.concat(source, F.lit("|id|"), scope, external_id)).otherwise(F.concat(source, F.lit("|content|"), scope, content)), 256)


def read_csv(spark: SparkSession, s: Source, path: str) -> DataFrame:
    """Landing rows of a bank's CSV. A bad date or amount fails the file."""
    wanted = tuple(dict.fromkeys(c.strip() for c in s.column_map.values()))
    raw = records(spark, path, s.skip_rows, s.columns, wanted)
    field = lambda name: F.col("fields")[wanted.index(s.column_map[name].strip())]
    day = F.to_timestamp(field("posted_on"), strptime_to_java(s.date_format)).cast("date")
    if s.sign == "debit_credit":
        amount = unsigned_amount(field("credit")) - unsigned_amount(field("debit"))
    else:
        amount = signed_amount(field("amount")) * (-1 if s.sign == "inverted" else 1)
    external = F.nullif(F.trim(field("external_id")), F.lit("")) if "external_id" in s.column_map else F.lit(None).cast("string")
    rows = raw.select("path", "file_row", day.alias("posted_on"), amount.cast("decimal(18,2)").alias("amount"), field("description_raw").alias("description_raw"), external.alias("external_id"))
    same = Window.partitionBy("path", "posted_on", "amount", "description_raw").orderBy("file_row")
    rows = rows.withColumn("occurrence", F.row_number().over(same) - 1)
    return landed(rows, s, row_hash(F.lit(s.name), F.col("external_id"), F.col("posted_on"), F.col("amount"), F.col("description_raw"), F.col("occurrence")))


def landed(rows: DataFrame, s: Source, key: Column) -> DataFrame:
    out = rows.withColumns({
        "source": F.lit(s.name), "account_name": F.lit(s.account_name), "account_type": F.lit(s.account_type), "currency": F.lit(s.currency),
        "source_file": F.regexp_extract("path", r"([^/]*)$", 1), "ingested_at": F.current_timestamp(), "row_hash": key,
    })
    return conform(out, BRONZE)


def ofx_statements(text: str | Iterable[str]) -> Iterator[tuple]:
    """(account, date, amount, id, description) of each transaction of an OFX file, SGML or XML, given as pieces in order.

    A piece may end anywhere: a tag and its value are read once the next tag has begun.
    """
    account, row, ledger, begun, n, rest, opening = "", None, False, False, 0, "", ""
    for piece in chain([text] if isinstance(text, str) else text, [None]):
        if not begun:
            opening = opening[-4:] + (piece or "")
            begun = "<OFX>" in opening.upper()
        rest += piece or ""
        # The last tag and its value may go on in the next piece.
        end = len(rest) if piece is None or "<" not in rest else rest.rfind("<")
        now, rest = rest[:end], rest[end:]
        for tag, value in re.findall(r"<(/?[A-Za-z0-9.]+)>([^<\r\n]*)", now):
            tag, value = tag.upper(), value.strip()
            for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
                value = value.replace(entity, char)
            if tag == "ACCTID":
                account = value
            elif tag == "LEDGERBAL":
                ledger = True
            elif tag == "STMTTRN":
                row, n = {}, n + 1
            elif tag == "/STMTTRN" and row is not None:
                name, memo = row.get("NAME", ""), row.get("MEMO", "")
                yield account, row["DTPOSTED"][:8], row["TRNAMT"], row.get("FITID") or None, name if not memo or memo in name else f"{name} {memo}".strip()
                row = None
            elif row is not None and value:
                row[tag] = value
    if not begun:
        raise ValueError("not an OFX file")
    if not ledger:
        raise ValueError("a statement lacks LEDGERBAL")


def read_ofx(spark: SparkSession, s: Source, path: str) -> DataFrame:
    """Landing rows of OFX or QFX files; ids are the bank's within an account."""
    schema = pa.schema([("path", pa.string()), ("file_row", pa.int64()), *((c, pa.string()) for c in ("account", "day", "amount", "external_id", "description_raw"))])

    def pieces(lines):
        some, size = [], 0
        for line in lines:
            some += line, OFX_ROW
            size += len(line)
            if size >= PIECE:
                yield b"".join(some).decode("utf-8", "replace")
                some, size = [], 0
        yield b"".join(some).decode("utf-8", "replace")

    def parse(batches):
        for name, lines in by_file(batches):
            yield from batched(((name, i, *r) for i, r in enumerate(ofx_statements(pieces(lines)))), schema)

    rows = lines_of(spark, path, OFX_ROW.decode()).mapInArrow(parse, "path string, file_row long, account string, day string, amount string, external_id string, description_raw string")
    rows = rows.withColumns({"posted_on": F.to_date("day", "yyyyMMdd"), "amount": signed_amount(F.col("amount"))})
    same = Window.partitionBy("path", "account", "posted_on", "amount", "description_raw").orderBy("file_row")
    rows = rows.withColumn("occurrence", F.row_number().over(same) - 1)
    return landed(rows, s, row_hash(F.lit(s.name), F.col("external_id"), F.col("posted_on"), F.col("amount"), F.col("description_raw"), F.col("occurrence"), F.col("account")))


# The order history export's column names.
ORDER_COLUMNS = {
    "website_order_id": "Order ID", "order_date": "Order Date", "ship_date": "Ship Date", "asin": "ASIN", "product_name": "Product Name", "quantity": "Quantity",
    "currency": "Currency", "order_status": "Order Status", "shipment_status": "Shipment Status", "unit_price": "Unit Price", "unit_price_tax": "Unit Price Tax",
    "shipping_charge": "Shipping Charge", "total_discounts": "Total Discounts", "shipment_item_subtotal": "Shipment Item Subtotal",
    "shipment_item_subtotal_tax": "Shipment Item Subtotal Tax", "total_owed": "Total Owed",
}


def read_orders(spark: SparkSession, s: Source, path: str) -> DataFrame:
    """Landing rows of an order history, each row_hash once; columns about persons and addresses are not read."""
    raw = records(spark, path, wanted=tuple(ORDER_COLUMNS.values()))
    text = {name: F.nullif(F.trim(F.col("fields")[k]), F.lit("")) for k, name in enumerate(ORDER_COLUMNS)}
    money = [f.name for f in BRONZE_ORDERS if f.dataType.simpleString().startswith("decimal")]
    cols = {n: signed_amount(c) if n in money else F.to_timestamp(c).cast("date") if n.endswith("_date") else c for n, c in text.items()}
    cols["quantity"] = text["quantity"].cast("bigint")
    cols["currency"] = F.coalesce(text["currency"], F.lit("USD"))
    what = F.concat_ws("|", F.lit(s.name), F.lit("order"), "website_order_id", "asin", F.coalesce(F.col("ship_date").cast("string"), F.lit("")))
    # A row's hash is that of this text and its place, so rows dealt by the text alone find their place, and equal ones each other, by one shuffle.
    rows = raw.select("path", "file_row", *(c.alias(n) for n, c in cols.items())).withColumn("_at", F.hash(what)).repartition("_at")
    same = Window.partitionBy("_at", "path", "website_order_id", "asin", "ship_date").orderBy("file_row")
    key = F.concat_ws("|", what, (F.row_number().over(same) - 1).cast("string"))
    once = first_per(rows.withColumn("row_hash", F.sha2(key, 256)), ["_at", "row_hash"], [F.col("path"), F.col("file_row")])
    return conform(once.withColumns({"source": F.lit(s.name), "source_file": F.regexp_extract("path", r"([^/]*)$", 1), "ingested_at": F.current_timestamp()}), BRONZE_ORDERS)


READERS = {"csv": read_csv, "ofx": read_ofx, "orders": read_orders}


def read(spark: SparkSession, s: Source, path: str) -> DataFrame:
    """Landing rows of `path`. Parsing happens on use, where any error is an IngestionError: see landing.ingest."""
    if s.kind not in READERS:
        raise IngestionError(f"{s.name}: kind {s.kind}")
    return READERS[s.kind](spark, s, path)
