"""Column functions on inline rows, at each bound and one step outside."""

import pytest
from pyspark.sql import functions as F

from tsubo.functions import attributes, text, urls


def test_clean_title(apply):
    cases = {
        "メゾン新宿 - Yahoo!不動産": "メゾン新宿",
        "メゾン新宿 | 賃貸": "メゾン新宿",
        "メゾン新宿｜賃貸": "メゾン新宿",
        "メゾン新宿 【賃貸】": "メゾン新宿",
        "【YAHOO不動産】メゾン": "メゾン",
        "　メゾン　": "メゾン",
        " - 先頭": "先頭",
        "｜先頭｜末尾": "先頭｜末尾",
        "Yahoo不動産": "",
        "普通の名前": "普通の名前",
    }
    assert apply(text.clean_title, list(cases)) == list(cases.values())


def test_clean_title_in_table(apply):
    cases = {
        "【Yahoo!不動産】メゾン": "メゾン",
        "メゾン【】新宿": "メゾン新宿",
        "メゾン【 】新宿": "メゾン新宿",
        "メゾン  新宿": "メゾン 新宿",
        "｜先頭": "",
        "--メゾン--": "メゾン",
        "  a  - b": "a",
        "メゾン 【特選】 - Yahoo不動産": "メゾン",
    }
    assert apply(text.clean_title_in_table, list(cases)) == list(cases.values())


def test_dirty_title(apply):
    cases = {"a - b": True, "a | b": True, "a｜b": True, "a【b": True, "Yahoo": True, "yahoo": True, "a-b": False}
    assert apply(text.is_dirty_title, list(cases)) == list(cases.values())


def test_floor_plan_normal_form(apply):
    cases = {
        "ワンルーム": "1R", "1R": "1R", "1LDK": "1LDK", "洋室6 1LDK": "1LDK", "2LDK+1K": "1K", "SLDK": "SLDK",
        " 洋室 ": "洋室", "": "", "9LDK": "9LDK", "21R": "1R",
    }
    assert apply(attributes.floor_plan, list(cases)) == list(cases.values())


def test_building_type(apply):
    cases = {
        ("アパート", "RC"): "mansion", ("マンション", "木造"): "apartment", ("", "鉄骨造"): "apartment",
        ("", "鉄骨鉄筋コンクリート"): "mansion", ("", "軽量鉄骨造"): "apartment", ("一戸建て", ""): "house",
        ("Foo", ""): "foo", ("", ""): "", ("シェアハウス", None): "share_house", ("タウンハウス", "ALC"): "town_house",
    }
    assert apply(attributes.building_type, list(cases)) == list(cases.values())


def test_facility_codes(apply):
    cases = {
        '["011","012","999"]': '["bath_toilet_separate"]', '["pet","001"]': '["auto_lock","pet_friendly"]',
        "not json": "not json", '["999"]': "", "[]": "",
    }
    assert apply(attributes.facility_codes_text, list(cases)) == list(cases.values())


def test_facility_labels(apply):
    def one(label):
        return F.array_join(attributes.label_keys(F.array(label)), ",")

    cases = {
        "シャワー": "shower", " 追い焚き風呂 ": "reheating_bath", "高速インターネット対応済": "internet_ready",
        "大型ウォークインクローゼット": "walk_in_closet", "未知": "",
    }
    assert apply(one, list(cases)) == list(cases.values())


def test_facility_text_forms(apply):
    def joined(c):
        return F.array_join(attributes.facility_list(c), "+")

    assert apply(joined, ['["a","b"]', "a / b", "a/b", '{"a":1}']) == ["a+b", "a+b", "a/b", '{"a":1}']
    assert apply(attributes.facility_name, ["ac", "loft", "zz"]) == ["エアコン", "ロフト", "zz"]


def test_rent_from_text(apply):
    cases = {
        "家賃8.5万円": 85000, "賃料: 85,000円": 85000, "賃料：90000円": 90000, "1万円": 10000, "0.9万円": None,
        "1000万円": 10000000, "1001万円": None, "0.5万円 賃料:12000円": 12000, "賃料:9999円": None, "なし": None,
    }
    assert apply(text.rent, list(cases)) == list(cases.values())


def test_floor_plan_from_text(apply):
    cases = {"1LDKの部屋": "1LDK", "2DK": "2DK", "LDK ": "LDK", "1LDKx": None, "洋室": None, "1LDK_": None, "3K/2DK": "3K"}
    assert apply(text.floor_plan, list(cases)) == list(cases.values())


@pytest.mark.parametrize(
    "function, cases",
    [
        (text.area, {"5㎡": 5.0, "4.99㎡": None, "500m²": 500.0, "500.1㎡": None, "25.5㎡": 25.5}),
        (text.walk_minutes, {"徒歩1分": 1, "徒歩0分": None, "歩60分": 60, "徒歩61分": None, "バス5分": None}),
        (text.building_age, {"築0年": 0, "築年数100年": 100, "築101年": None, "築浅": None}),
        (text.floor, {"0階": 0, "100F": 100, "101階": None, "B1": None}),
        (text.station, {"新宿駅 徒歩5分": "新宿駅", "線/新宿駅徒歩": "線/新宿駅", "新宿駅 バス": None}),
    ],
)
def test_values_from_text(function, cases, apply):
    assert apply(function, list(cases)) == list(cases.values())


def test_address(apply):
    long = "東京都" + "あ" * 60
    cases = {"住所 東京都新宿区1-2 \n次": "東京都新宿区1-2", long: long, "北海道札幌市": None}
    assert apply(text.address, list(cases)) == list(cases.values())
    assert apply(lambda c: text.address(c, 50), [long]) == [long[:50]]


def test_escapes_and_space(apply):
    cases = {r"東京": "東京", r"a\/b": "a/b", 'x"y': 'x"y', r"bad\q": r"bad\q", "": ""}
    assert apply(text.unescape_json, list(cases)) == list(cases.values())
    assert apply(text.squeeze, ["a　　b\n\tc"]) == ["a b c"]


def test_url_forms(apply):
    cases = {
        "http://a.example/x/?q=1#f": ("https://a.example/x", "http://a.example/x", "http://a.example/x"),
        "https://a.example/": ("https://a.example", "https://a.example/", "https://a.example"),
        "https://a.example/rent/detail/1/": (
            "https://a.example/rent/detail/1", "https://a.example/rent/detail/1/", "https://a.example/rent/detail/1",
        ),
        "a.example/x": ("https://a.example/x", "a.example/x", "a.example/x"),
        "https://a.example/%zz/": ("https://a.example/%zz/",) * 3,
    }
    forms = [urls.storage_form, urls.crawl_form, urls.existence_form]
    for i, form in enumerate(forms):
        assert apply(form, list(cases)) == [c[i] for c in cases.values()]


def test_source_id(apply):
    import hashlib

    def url(n):
        return "https://a.example/rent/detail/" + "a" * n

    hashed = {n: hashlib.md5(url(n).encode()).hexdigest() for n in (39, 49)}
    want = [hashed[39], "a" * 40, "a" * 48, hashed[49]]
    assert apply(urls.source_id, [url(n) for n in (39, 40, 48, 49)]) == want
    assert apply(urls.source_id, [url(40) + "/?x=1"]) == ["a" * 40]
    twice = "x/detail/y/detail/" + "a" * 40
    assert apply(urls.source_id, [twice]) == [hashlib.md5(twice.encode()).hexdigest()]


def test_labels(apply):
    assert apply(attributes.rent_label, [85000, 85500, 99500, 0, None, 1_234_500], "int") == [
        "8.5", "8.6", "10.0", None, None, "123.5",
    ]
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    times = ["2024-01-30 00:00:00", "2024-01-30 00:00:01", "2024-01-30 23:59:00", "2024-01-30 23:59:30"]
    assert apply(lambda c: attributes.age_label(c, as_of), times) == ["1日前", "23時間前", "1分前", "今"]
    assert apply(lambda c: attributes.days_since_seen(c, as_of), [times[0], None]) == [1, 9999]
    assert apply(attributes.retry_delay_seconds, [0, 1, 2, 3, 4, 9], "int") == [300, 900, 3600, 14400, 43200, 43200]


def test_strip_takes_every_white_space(spark):
    chars = [(chr(i) + f"a{chr(i)}b " + chr(i) + "\n",) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([*chars, (None,), ("",), (" 　\r\n",), ("a\n",)], "t string")
    by_class = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.where(~text.strip(F.col("t")).eqNullSafe(by_class)).count() == 0


def test_json_text_without_escapes_stays(apply):
    cases = {"メゾン": "メゾン", "\\u30e1": "メ", "a\\/b": "a/b", 'a","x":"b': "a", 'a"b': 'a"b', "a\tb": "a\tb", "\\x": "\\x", "": "", None: None}
    assert apply(text.unescape_json, list(cases)) == list(cases.values())
