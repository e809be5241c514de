"""Catalogue rules: update-from-scrape, dispatch, not-found, work list, URLs."""

from datetime import datetime

from storelens.operators import catalog as C

CAT = "id long, name string, bundle_id string, store string, developer_name string, description string, " \
      "icon_url string, is_active boolean"


def test_apps_merge_rules(spark):
    cat = spark.createDataFrame([(1, "Old", "com.a", C.APPLE, "Dev", "Desc", "i.png", True),
                                 (2, "Keep", "com.b", C.APPLE, "D2", None, None, True)], CAT)
    scraped = spark.createDataFrame([(1, "New", "", None, "j.png")],
                                    "app_id long, name string, developer_name string, description string, icon_url string")
    out = {r["id"]: r for r in C.apps_merge(cat, scraped).collect()}
    a = out[1]
    assert (a["name"], a["bundle_id"], a["developer_name"], a["description"], a["icon_url"], a["changed"]) == \
        ("New", "com.a", "Dev", "Desc", "j.png", True)  # name always; blanks keep the old value
    assert out[2]["name"] == "Keep" and out[2]["changed"] is False


def test_request_lookup_dispatch(spark):
    apps = spark.createDataFrame([(1, "x", "42", C.APPLE, None, None, None, True),
                                  (2, "y", "com.g", C.GOOGLE, None, None, None, True)], CAT)
    req = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 1)], "request_id long, app_id long")
    out = {r["request_id"]: r for r in C.request_lookup(req, apps).collect()}
    assert out[10]["dispatched"] and out[10]["url"] == "https://apps.apple.com/us/app/id42"
    assert not out[11]["dispatched"] and out[11]["error"] == C.GOOGLE_NOT_IMPLEMENTED
    assert out[11]["url"] == "https://play.google.com/store/apps/details?id=com.g&hl=en&gl=US"
    assert out[12]["error"] == C.APP_NOT_FOUND and out[12]["found"] is False
    assert C.enqueued_count(req).first()["enqueued"] == 4  # duplicates and unknown ids count


def test_worklist_modes(spark):
    apps = spark.createDataFrame([(1, "a", "b", C.APPLE, None, None, None, True),
                                  (2, "a", "b", C.APPLE, None, None, None, True),
                                  (3, "a", "b", C.APPLE, None, None, None, True),
                                  (4, "a", "b", C.APPLE, None, None, None, False)], CAT)
    att = spark.createDataFrame([(1, datetime(2024, 1, 30, 11, 30)), (2, datetime(2024, 1, 30, 10, 0)),
                                 (4, datetime(2024, 1, 30, 11, 59))], "app_id long, ts timestamp_ntz")
    out = {r["app_id"]: r["mode"] for r in C.worklist(apps, att, "2024-01-30 12:00:00").collect()}
    assert out == {1: "price_only", 2: "full", 3: "full"}  # inactive app 4 is not monitored


def test_store_urls_regions(spark):
    apps = spark.createDataFrame([(1, "a", "42", C.APPLE, None, None, None, True)], CAT)
    urls = {r["region"]: r["url"] for r in C.store_urls(apps, ["us", "mx"]).collect()}
    assert urls == {"us": "https://apps.apple.com/us/app/id42", "mx": "https://apps.apple.com/mx/app/id42"}
