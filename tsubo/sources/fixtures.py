"""Listing tables made from the supplied order tables.

Every view is a projection, an aggregate or a join over whole tables. Columns
that need another table are optional, so a query reads only what it uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.functions.attributes import plus_seconds, retry_delay_seconds
from tsubo.operators.keyed import numbered

LISTINGS_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
SOURCE = "demo"

PLANS = ["1R", "1K", "1DK", "1LDK", "2K", "2DK", "2LDK", "3DK", "3LDK", "4LDK"]
TYPES = ["mansion", "apartment", "house", "terrace_house", "share_house"]
FACILITIES = ["auto_lock", "balcony", "flooring", "elevator", "city_gas", "storage"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _ident(key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{SOURCE}:"), F.col(key).cast("string")))


def _detail_url(key: str) -> Column:
    return F.concat(F.lit("https://listings.example/rent/detail/"), F.lpad(F.col(key).cast("string"), 40, "0"))


def listings(
    spark: SparkSession, folder: str, title: bool = False, walk: bool = False, place: bool = False
) -> DataFrame:
    orders = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    gone = F.col("o_orderstatus") == "F"
    facilities = F.array_compact(
        F.array(*[F.when(k % (i + 2) == 0, F.lit(name)) for i, name in enumerate(FACILITIES)])
    )
    extra = []
    if title or place:
        customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
        orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        if title:
            extra.append(F.concat_ws(" - ", "c_name", "c_mktsegment").alias("title"))
    if place:
        nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
        orders = orders.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        extra += [
            F.when(k % 19 == 0, F.lit("")).otherwise(F.col("n_name")).alias("station"),
            F.concat_ws(" ", "n_name", "c_mktsegment").alias("address"),
        ]
    if walk:
        nearest = (
            table(spark, folder, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.min(F.col("l_quantity").cast("int")).alias("walk_time"))
        )
        orders = orders.join(nearest, k == F.col("l_orderkey"), "left")
        extra.append(F.col("walk_time"))
    return orders.select(
        _ident("o_orderkey").alias("id"),
        F.lit(SOURCE).alias("source"),
        k.cast("string").alias("source_property_id"),
        _detail_url("o_orderkey").alias("detail_url"),
        F.concat(F.lit("https://img.example/"), k.cast("string"), F.lit(".jpg")).alias("image_url"),
        F.when(k % 17 != 0, F.floor("o_totalprice").cast("int")).alias("rent"),
        F.when(k % 23 != 0, ((k % 800 + 50) / 10).cast("decimal(10,2)")).alias("area"),
        pick(PLANS, k).alias("floor_plan"),
        pick(TYPES, k).alias("building_type"),
        (k % 50).cast("int").alias("building_age"),
        (k % 30 + 1).cast("int").alias("floor"),
        facilities.alias("facilities"),
        F.when(gone, vocab.REMOVED).otherwise(vocab.ACTIVE).alias("status"),
        F.when(gone, plus_seconds(F.col("o_orderdate"), 30 * 86400)).alias("removed_at"),
        F.when(k % 13 != 0, plus_seconds(F.col("o_orderdate"), (k % 40) * 86400)).alias("last_seen_at"),
        F.col("o_orderdate").alias("fetched_at"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        k.alias("order_key"),
        *extra,
    )


def _placed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their position in the order. The part key refines the
    chunks, so an order with very many lines is numbered by many tasks."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"
    )
    # every column, so that stations and images share one numbering in a query that reads both
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
    chunk = F.struct("l_linenumber", F.shiftright("l_partkey", 12))
    return numbered(lines, ["l_orderkey"], order, chunk, "sort_order")


def stations(spark: SparkSession, folder: str, ordered: bool = False, named: bool = True) -> DataFrame:
    """Order lines as stations; `ordered` adds sort_order, `named` the names."""
    lines = _placed_lines(spark, folder) if ordered else table(spark, folder, "lineitem")
    columns = [_ident("l_orderkey").alias("property_id"), F.col("l_quantity").cast("int").alias("walk_minutes")]
    if ordered:
        columns.append(F.col("sort_order").cast("int").alias("sort_order"))
    if named:
        supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
        lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        lines = lines.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        columns += [F.col("n_name").alias("station_name"), F.col("s_name").alias("line_name")]
    return lines.select(*columns)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as images, numbered from 0."""
    picture = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return _placed_lines(spark, folder).select(
        _ident("l_orderkey").alias("property_id"),
        F.concat(F.lit("https://img.example/"), picture, F.lit(".jpg")).alias("image_url"),
        (F.col("sort_order") - 1).cast("int").alias("sort_order"),
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part and ship date; rent is coarse so that unchanged pairs exist."""
    rent = F.floor(F.max("l_extendedprice") / 20000) * 20000
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("property_id"), F.to_date("l_shipdate").alias("snapshot_at"))
        .agg(
            rent.cast("bigint").alias("rent"),
            F.max("l_quantity").cast("decimal(10,2)").alias("area"),
            F.min("l_returnflag").alias("floor_plan"),
            F.min("l_linestatus").alias("status"),
        )
    )


def crawl(spark: SparkSession, folder: str, **parts: bool) -> DataFrame:
    """A later state of the listings: some gone, some dearer, some new."""
    k = F.col("order_key")
    before = listings(spark, folder, **parts)
    dearer = F.when(k % 7 == 0, F.col("rent") + 1000).otherwise(F.col("rent"))
    stays = before.filter(k % 11 != 0).withColumn("rent", dearer)
    fresh = before.filter(k % 13 == 0).withColumns(
        {
            "source_property_id": F.concat(F.lit("n"), k.cast("string")),
            "id": F.md5(F.concat(F.lit(f"{SOURCE}:n"), k.cast("string"))),
            "detail_url": F.concat(F.col("detail_url"), F.lit("n")),
        }
    )
    # a crawl sees only listings that are up
    alive = {"status": F.lit(vocab.ACTIVE), "removed_at": F.lit(None).cast("timestamp")}
    return stays.unionByName(fresh).withColumns(alive)


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """User marks on two fifths of the listings."""
    k = F.col("o_orderkey")
    mark = F.when(k % 5 == 0, "candidate").when(k % 5 == 1, "maybe").when(k % 10 == 2, "excluded")
    rows = table(spark, folder, "orders").select(_ident("o_orderkey").alias("property_id"), mark.alias("mark"))
    return rows.filter(F.col("mark").isNotNull())


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a request log."""
    failed = F.col("event_type") == "error"
    codes = F.array(F.lit(500), F.lit(429), F.lit(403), F.lit(404))
    return request_rows(table(spark, folder, "events"), failed, codes)


def request_rows(events: DataFrame, failed: Column, codes: Column) -> DataFrame:
    code = F.when(failed, F.element_at(codes, (F.col("event_id") % 4 + 1).cast("int"))).otherwise(F.lit(200))
    return events.select(
        F.col("user_id").alias("key"),
        "ts",
        F.col("event_id").alias("id"),
        failed.alias("failed"),
        code.alias("status_code"),
    )


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """One work item per user; the latest event decides its status."""
    events = table(spark, folder, "events")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    rows = events.groupBy("user_id").agg(
        last.alias("_last"),
        F.count_if(F.col("event_type") == "error").cast("int").alias("attempts"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )
    words = {"view": "pending", "click": "processing", "signup": "done", "purchase": "permanent_fail"}
    status = F.lit("failed")
    for word, state in words.items():
        status = F.when(F.col("_last") == word, state).otherwise(status)
    failed, retry = F.col("status") == "failed", F.col("attempts") < 100
    due = plus_seconds(F.col("updated_at"), retry_delay_seconds(F.col("attempts") - 1))
    return (
        rows.withColumn("status", status)
        .select(
            F.col("user_id").alias("id"),
            F.lit(SOURCE).alias("source"),
            F.col("user_id").cast("string").alias("source_property_id"),
            _detail_url("user_id").alias("detail_url"),
            "status",
            (F.col("user_id") % 3).cast("int").alias("priority"),
            "attempts",
            F.when(failed, "timeout").otherwise("").alias("last_error"),
            F.when(failed & retry, due).alias("next_retry_at"),
            "created_at",
            "updated_at",
            F.when(F.col("status").isin("done", "permanent_fail"), F.col("updated_at")).alias("completed_at"),
        )
    )


def delete_logs(spark: SparkSession, folder: str) -> DataFrame:
    gone = listings(spark, folder).filter(F.col("status") == vocab.REMOVED)
    return gone.select(
        F.col("id").alias("property_id"),
        F.lit("").alias("title"),
        "detail_url",
        "removed_at",
        plus_seconds(F.col("removed_at"), 90 * 86400).alias("deleted_at"),
        pick(vocab.DELETE_REASONS, F.col("order_key")).alias("reason"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


# ------------------------------------------------- texts written from orders
WARDS = ["新宿区", "渋谷区", "港区", "目黒区"]
STRUCTURES = ["鉄筋コンクリート", "木造", "軽量鉄骨", "鉄骨造", "SRC", ""]
KINDS = ["マンション", "アパート", "一戸建て", "テラスハウス", "Loft"]
ROOM_LAYOUTS = ["ワンルーム", "洋室6 1K", "1DK", "洋室6 LDK10 2LDK", "3SLDK", "和室 5LDKS", "4DK+1K"]
CODES = ["011", "012", "001", "022", "030", "999", "pet"]


def raw_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with raw attribute texts, as a page would give them."""
    k = F.col("o_orderkey")
    brand = pick(vocab.BRANDS, k)
    name = F.concat(F.lit("メゾン"), k.cast("string"))
    forms = [
        F.concat(name, F.lit(" - "), brand),
        F.concat(name, F.lit(" | 賃貸"), brand),
        F.concat(name, F.lit("｜"), brand),
        F.concat(name, F.lit(" 【"), brand, F.lit("】")),
        F.concat(F.lit("【"), brand, F.lit("】"), name),
        name,
    ]
    codes = F.array(pick(CODES, k), pick(CODES, F.floor(k / 3)), pick(CODES, F.floor(k / 5)))
    labels = list(vocab.FACILITY_LABELS)
    label = pick(labels, k)
    page_labels = F.array(
        F.concat(F.lit(" "), label), F.concat(F.lit("対応 "), pick(labels, k * 3 + 1)), F.lit("その他設備")
    )
    return table(spark, folder, "orders").select(
        k.alias("order_key"),
        F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int")).alias("raw_title"),
        pick(ROOM_LAYOUTS, k).alias("raw_layout"),
        pick(KINDS, k).alias("raw_kind"),
        pick(STRUCTURES, F.floor(k / 2)).alias("raw_structure"),
        F.when(k % 9 == 0, F.lit("not json")).otherwise(F.to_json(codes)).alias("raw_codes"),
        codes.alias("codes"),
        page_labels.alias("raw_labels"),
        ((k * 37) % 1200 * 1000 + 500).cast("int").alias("yen"),
        (k % 620).cast("int").alias("square_metres"),
        (k % 70).cast("int").alias("minutes"),
        (k % 110).cast("int").alias("years"),
        (k % 13).cast("int").alias("storey"),
    )


def raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The same orders as one free text each, like the text of a page."""
    rows = raw_attributes(spark, folder)
    k = F.col("order_key")
    man = F.concat(F.floor(F.col("yen") / 10000).cast("string"), F.lit("."), F.floor(F.col("yen") / 1000 % 10).cast("string"))
    price = F.when(k % 2 == 0, F.concat(F.lit("賃料 "), man, F.lit("万円"))).otherwise(
        F.concat(F.lit("賃料： "), F.format_number("yen", 0), F.lit("円"))
    )
    line = F.concat(
        price, F.lit("\n"),
        pick(["1LDKの部屋", "3DK", "広い部屋", "2SLDK南"], k), F.lit(" "),
        F.col("square_metres").cast("string"), F.lit(".5㎡\n"),
        F.lit("　"), pick(WARDS, k), F.lit("中央駅 徒歩"), F.col("minutes").cast("string"), F.lit("分\n"),
        F.lit("築年数"), F.col("years").cast("string"), F.lit("年 "), F.col("storey").cast("string"), F.lit("階\n"),
        F.lit("所在地 "), pick(vocab.PREFECTURES + ["北海道"], k), pick(WARDS, k), F.lit("本町"),
        F.repeat(F.lit("あ"), (k % 60).cast("int")), F.lit("  \n以上"),
    )
    return rows.withColumn("page_text", line)


def detail_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One detail page per order, two thirds of them with a state block."""
    # dealt out while the rows are narrow, so that a file with one row group is not one task of pages
    rows = raw_texts(spark, folder).repartition("order_key")
    k = F.col("order_key")
    number = k.cast("string")

    def text(value: str | Column) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    def joined(*parts: str | Column) -> Column:
        return F.concat(*[text(p) for p in parts])

    state = joined(
        '<script>window.__SERVER_SIDE_CONTEXT__ = {"Price": ', F.col("yen").cast("string"),
        ',"BuildingName":"\\u30e1\\u30be\\u30f3', number, '","MonopolyArea":', (F.col("square_metres") * 100 + 25).cast("string"),
        ',"MinutesFromStation":', F.col("minutes").cast("string"), ',"FloorNum":"', F.col("storey").cast("string"),
        '","AddressName":"\\u6771\\u4eac\\u90fd', pick(WARDS, k), '","StationName":"', pick(WARDS, k), '駅","YearsOld":',
        F.col("years").cast("string"), ',"Direction":"\\u5357","StructureName":"', F.col("raw_structure"),
        '","RoomLayoutBreakdown":"', F.col("raw_layout"), '","KindName":"', F.col("raw_kind"),
        '","Facilities":', F.to_json("codes"), ',"Pickouts":["ac","al"],"FloorNameLabel":"', F.col("storey").cast("string"),
        '\\u968e","RoomLayoutImageUrl":"https:\\/\\/img.example\\/', number, '.png"};</script>',
    )
    access = joined(
        '<ul><li class="x DetailSummaryTable__access"><a class="_SummaryStation" href="/s">', pick(WARDS, k), '駅</a>',
        '/　東西 線\n 徒歩', (k % 130).cast("string"), '分</li>',
        '<li class="DetailSummaryTable__access"><a class="_SummaryStation">', pick(WARDS, k + 1), '駅</a>/南北線 バス12分</li>',
        '<li class="DetailSummaryTable__access">駅名なし 徒歩3分</li></ul>',
    )
    tail = F.repeat(F.lit("x"), 100)
    picture = joined("https://realestate-pctr.c.yimg.jp/", F.rpad(number, 110, "a"))
    images = joined(
        '<img src="', picture, F.rpad(F.lit("one"), 100, "b"), tail, '"><img src="', picture,
        F.rpad(F.lit("one"), 100, "b"), '"><img src="', picture, F.rpad(F.lit("two"), 100, "c"), '">',
    )
    amenities = joined(
        '<h3>人気の特徴・設備</h3><div><p class="i"><img alt="オートロック"></p><p class="i i--disabled">',
        '<img alt="エレベーター"></p><ul><li>', F.when(k % 2 == 0, "ペット可").otherwise("2階以上"), '</li><li>その他</li></ul></div>',
    )
    lines = joined("<pre>\nバス・トイレ シャワー / トイレ / 風呂\nキッチン ", pick(["ガスコンロ", "システムキッチン"], k), " /\n</pre>")
    canonical = F.when(
        k % 5 == 0, joined('<link rel="canonical" href="https://listings.example/rent/detail/', F.lpad(number, 44, "0"), '/?from=c#top">')
    ).otherwise("")
    og_title = F.when(k % 4 == 0, joined('<meta property="og:title" content=" ', F.col("raw_title"), ' ">')).otherwise("")
    og_image = joined('<meta property="og:image" content="https://img.example/og', number, '.jpg">')
    html = joined(
        "<html><head>", og_title, canonical, og_image, "<title>", F.when(k % 3 == 0, "").otherwise(F.col("raw_title")),
        "</title></head><body><h1>", F.when(k % 6 == 3, "").otherwise(joined("部屋", number)), "</h1>\n<div>",
        F.col("page_text"), "</div>\n", access, F.when(k % 7 == 0, "").otherwise(images), amenities, lines,
        F.when(k % 3 == 1, "").otherwise(state), "</body></html>",
    )
    url = joined("http://listings.example/rent/detail/", F.lpad(number, 44, "0"), "/?page=", number)
    return rows.select(k.alias("page_id"), url.alias("url"), html.alias("html"))


def list_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One list page per customer key with checkboxes: a long id twice, another
    long one and one that is too short."""
    k = F.col("c_custkey").cast("string")
    box = F.lit('<input type="checkbox" class="a _propertyCheckbox" value="')
    one, two = F.concat(F.lit("_0000"), F.lpad(k, 40, "a")), F.lpad(k, 40, "b")
    html = F.concat(
        box, one, F.lit('"><p>x</p>'), box, two, F.lit('">'), box, one, F.lit('">'), box, F.lit("short"), F.lit('">'),
        F.lit('<input class="other" value="'), F.lpad(k, 44, "c"), F.lit('">'),
    )
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html"))
