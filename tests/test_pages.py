"""Extraction from page snippets."""

from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.functions import text
from tsubo.operators import pages
from tsubo.plans import ingest


def page(spark, html, url="https://a.example/rent/detail/" + "a" * 44):
    return spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")


def one(df, column):
    return df.select(column.alias("v")).first().v


def test_title_order(spark):
    def title(html):
        return one(page(spark, html), pages.page_title(F.col("html")))

    og, tw = '<meta property="og:title" content=" OG &amp; co ">', "<meta name='twitter:title' content='TW'>"
    assert title(og + tw + "<title>T</title>") == "OG & co"
    assert title('<meta property="og:title" content=" ">' + tw) == "TW"
    assert title("<title> T </title><h1>H</h1>") == "T"
    assert title("<title></title><h1 class='x'><b>H</b>1</h1>") == "H1"
    assert title("<p>nothing</p>") == "No Title"
    assert one(page(spark, "<title>Yahoo不動産</title>"), pages.cleaned_page_title(F.col("html"))) == "No Title"


def test_state_first_piece_of_a_key_counts(spark):
    html = (
        '"Price": 1 __SERVER_SIDE_CONTEXT__ = {"Price":"none","Price" : 85000,"Price":2,"FloorNum":"3",'
        '"MonopolyArea":2550,"YearsOld":0,"KindName":"\\u30a2\\u30d1\\u30fc\\u30c8","Facilities":["001","999"],'
        '"RoomLayoutImageUrl":"https:\\/\\/i.example\\/a.png","MinutesFromStation":99999999999}'
    )
    row = pages.with_state(page(spark, html)).select("state.*").first()
    assert (row.Price, row.FloorNum, row.MonopolyArea, row.YearsOld) == (85000, 3, 2550, 0)
    assert row.MinutesFromStation is None
    assert row.RoomLayoutImageUrl == "https://i.example/a.png"
    fields = {k: v.alias(k) for k, v in pages.state_fields().items()}
    got = pages.with_state(page(spark, html)).select(*fields.values()).first()
    assert (got.rent, float(got.area), got.building_age, got.building_type) == (85000, 25.5, 0, "apartment")
    assert got.facilities == ["auto_lock"]


def test_bare_floor_number_wins(spark):
    html = '__SERVER_SIDE_CONTEXT__ {"FloorNum":"3","x":{"FloorNum":7}}'
    assert pages.with_state(page(spark, html)).select("state.FloorNum").first()[0] == 7


def test_no_state_without_mark_or_keys(spark):
    for html in ('{"Price":1}', "__SERVER_SIDE_CONTEXT__ = {}"):
        assert pages.with_state(page(spark, html)).select("state").first()[0] is None


def test_state_far_behind_the_mark_is_read(spark):
    html = "__SERVER_SIDE_CONTEXT__" + " " * 600_000 + '"Price":85000'
    assert pages.with_state(page(spark, html)).select("state.Price").first()[0] == 85000


def test_access_items(spark, rows):
    html = """
      <li class="DetailSummaryTable__access"><a class="_SummaryStation" href="#">新宿駅</a>/東京メトロ　丸ノ内線
         徒歩6分</li>
      <li class="DetailSummaryTable__access">名前なし 徒歩3分</li>
      <li class="x DetailSummaryTable__access y"><a class="_SummaryStation">渋谷駅</a>/山手線 バス10分</li>
      <li class="DetailSummaryTable__access"><a class="_SummaryStation">池袋駅</a>/ 西武線 徒歩121分</li>
      <li class="DetailSummaryTable__access"><a class="_SummaryStation">上野駅</a>/銀座線</li>"""
    assert rows(pages.access_rows(page(spark, html)).orderBy("sort_order").drop("page_id")) == sorted(
        [
            ("新宿駅", "東京メトロ 丸ノ内線", 6, 1), ("渋谷駅", "山手線", 0, 2), ("池袋駅", "西武線", 0, 3),
            ("上野駅", "銀座線", 0, 4),
        ],
        key=repr,
    )


def test_images(spark):
    base = "https://realestate-pctr.c.yimg.jp/" + "a" * 106
    same = [base + "s" * 100 + end for end in ("x" * 10, "y" * 20)]
    others = [base + f"{i:03d}" + "t" * 97 for i in range(25)]
    html = " ".join([*same, *others])

    def images(text_):
        return one(page(spark, text_), pages.page_images(F.col("html")))

    assert images(html) == [*same, *others]
    found = F.regexp_extract_all(F.lit(html), F.lit(vocab.IMAGE_URL_PATTERN), 0)
    assert one(page(spark, html), pages.distinct_images(found, by_signature=True)) == [same[0], *others]
    assert one(page(spark, html), pages.distinct_images(found, 20, by_signature=True)) == [same[0], *others[:19]]
    assert one(page(spark, html), pages.distinct_images(found, 3)) == [*same, others[0]]
    fallback = '"ResizedExternalImageUrls":[{"Url":"https:\\/\\/i.example\\/1"},{"Url":"https:\\/\\/i.example\\/1"}]'
    assert images(fallback) == ["https://i.example/1"]
    assert images('"ExternalImageUrl":"https:\\/\\/i.example\\/2"') == ["https://i.example/2"]
    assert images('<meta property="og:image" content="https://i.example/3">') == ["https://i.example/3"]
    assert images("none") == []


def test_section_labels(spark):
    html = """<div><h3> 人気の特徴・設備 </h3><div>
        <p class="icon"><img alt=" オートロック "></p><p class="icon --disabled"><img alt="エレベーター"></p>
        <ul><li>2階以上</li><li>南向き</li><li>とても長い説明文なので設備の名前ではない可</li></ul></div></div>
        <div><img alt="外"></div>"""
    got = pages.section_labels(page(spark, html)).first().labels
    assert got == ["オートロック", "2階以上", "とても長い説明文なので設備の名前ではない可"]
    short = page(spark, html).select(pages.page_section_labels(F.col("html"), 30).alias("labels")).first().labels
    assert short == ["オートロック", "2階以上"]
    assert pages.section_labels(page(spark, "<p>x</p>")).count() == 0
    # no sibling after the heading: the parent's next sibling is the scope
    html = "<section><h2>人気の特徴・設備</h2></section><div><img alt='床暖房'></div>"
    assert pages.section_labels(page(spark, html)).first().labels == ["床暖房"]


def test_first_element():
    nested = "<div><div>a<p>b</p></div><br><img><section>c</section></div>"
    cases = {
        nested + "<div>d</div>": nested, "</p></div>x" + nested + "y": nested, "<!-- <div> -->" + nested: nested,
        "<div>a<!-- </div> -->b</div>c": "<div>a<!-- </div> -->b</div>", "<br><hr/><ul><li>1<li>2</ul>": "<ul><li>1<li>2</ul>",
        "<DIV>a</DIV>b": "<DIV>a</DIV>", "<div/><p>x</p>": "<p>x</p>", "no tag < here": None, "": None, "<div>open": "<div>open",
    }
    for after, element in cases.items():
        assert pages.first_element(after) == element, after
    assert pages.first_element(None) is None


def test_a_page_of_five_megabytes(spark):
    depth = 30_000
    html = "<h3>人気の特徴・設備</h3>" + "<div>" * depth + "<li>2階以上</li>" + "<p>x</p>" * 400_000 + "</div>" * depth + "<li>ペット可</li>"
    assert len(html) > 5_000_000 * 0.7
    assert pages.section_labels(page(spark, html + "<span>" * 200_000)).first().labels == ["2階以上"]


def test_ten_thousand_images_on_a_page(spark):
    base = "https://realestate-pctr.c.yimg.jp/" + "a" * 106
    found = [base + f"{i % 6000:06d}" + "t" * 94 + f"{i}" for i in range(10_000)]
    frame = spark.createDataFrame([(found,), ([],), (None,), ([None, "b", None, "b"],)], "urls array<string>").coalesce(1)
    whole = [r[0] for r in frame.select(pages.distinct_images(F.col("urls"), by_signature=True)).collect()]
    assert whole == [found[:6000], [], None, ["b"]]
    assert frame.select(pages.distinct_images(F.col("urls"), 7, by_signature=True)).first()[0] == found[:7]


def test_category_lines(spark):
    html = "<div>\n バス・トイレ シャワー / トイレ / シャワー\r\nキッチン IHコンロ/\nその他\n無関係 a/b</div>"
    got = one(page(spark, html), pages.category_labels(text.visible_text(F.col("html"))))
    assert got == ["シャワー", "トイレ", "IHコンロ"]


def test_list_page(spark, rows):
    ids = ["_0000" + "a" * 40, "b" * 40, "c" * 39]
    html = "".join(f'<input type="checkbox" class="_propertyCheckbox" value="{i}">' for i in [*ids, ids[0]])
    got = rows(pages.listed_urls(page(spark, html), base="https://a.example/rent/detail/"))
    assert got == [(1, 0, "https://a.example/rent/detail/" + ids[0]), (1, 1, "https://a.example/rent/detail/" + ids[1])]


def test_page_row_without_state_reads_text(spark):
    html = "<title>部屋 | x</title><p>賃料: 85,000円\n2DK 30.5㎡\n新宿駅 徒歩5分\n築3年 2階\n東京都新宿区1</p>"
    row = ingest.page_rows(page(spark, html), "demo", "2024-01-01 00:00:00").first()
    assert (row.title, row.rent, row.floor_plan, float(row.area)) == ("部屋", 85000, "2DK", 30.5)
    assert (row.station, row.walk_time, row.building_age, row.floor) == ("新宿駅", 5, 3, 2)
    assert row.address == "東京都新宿区1"


def test_building_name_replaces_missing_title(spark):
    html = '__SERVER_SIDE_CONTEXT__ {"BuildingName":"\\u30e1\\u30be\\u30f3"}'
    assert ingest.page_rows(page(spark, html), "demo", "2024-01-01 00:00:00").first().title == "メゾン"


ODD_HEADS = [
    '<META x <link rel="canonical" href="http://a/b/"><meta property="og:title" content="t">',
    '<meta property="og:title"\ncontent="one"><link\nrel = \'canonical\' href="/x/y/">', '<link rel="canonical" href="/x"', "<metaa><linkrel>", "", None,
    '<!-- <meta property="og:title" content="c"> --><linkx><link href="/z" rel="canonical"><link rel="canonical" href="/w">',
]


def test_head_tags_hold_what_the_page_holds(apply):
    for tag, attribute, value in (("meta", "property", "og:title"), ("link", "rel", "canonical")):
        whole = apply(lambda c: pages._tag(c, tag, attribute, value), ODD_HEADS)
        assert apply(lambda c: pages._tag(pages.head_tags(c), tag, attribute, value), ODD_HEADS) == whole
        assert any(whole)


def test_the_address_is_looked_for_once(spark):
    rows = spark.createDataFrame([(1, "http://a/b", "<p>")], "page_id long, url string, html string")
    read = rows.select(pages.page_address(F.col("url"), F.col("html")).alias("address"))
    assert read._jdf.queryExecution().analyzed().toString().count("canonical") == 1


def test_a_value_of_a_page_is_made_once(spark):
    """No pattern stands in the plan again where a value is tested before it is taken."""
    rows = ingest.page_rows(page(spark, "<p>x</p>"), "demo", "2001-08-02 00:00:00")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    for pattern in ("og:title", "twitter:title", "(?is)<h1", pages.ACCESS_LINE, pages.ACCESS_WALK, text.WALK, text.AREA, text.FLOOR, text.BUILDING_AGE,
                    text.RENT_IN_MAN, text.RENT_IN_YEN):
        assert plan.count(pattern) == 1, pattern


def test_state_values_in_odd_spacing(spark):
    html = ('__SERVER_SIDE_CONTEXT__ {"BuildingName"\n:\t" : a: ","Price"  :  7,"FloorNum" : "12","Facilities" :\n["001", "a:b"],'
            '"StationName":":","Direction":" ","YearsOld":99999999999,"MinutesFromStation" :05}')
    s = pages.with_state(page(spark, html)).first().state
    assert (s.BuildingName, s.Price, s.FloorNum, s.Facilities) == (" : a: ", 7, 12, '["001", "a:b"]')
    assert (s.StationName, s.Direction, s.YearsOld, s.MinutesFromStation, s.KindName) == (":", " ", None, 5, None)
