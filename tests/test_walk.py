"""Folder requests walked level by level give what matching against all full paths gives."""

from ratebook.operators import inventory as iv

SCHEMA = "id string, name string, parent_id string, item_type string"


def answers(df):
    return sorted((tuple(r) for r in df.select("path", "folder_id", "missing_prefix").collect()), key=str)


def test_walk_equals_full_paths(spark):
    tree = [("a", "A", "root", "folder"), ("b", "B", "a", "folder"), ("c", "C", "b", "folder"), ("f", "F", "b", "file"),
            ("d", "B", "root", "folder"), ("x", "X", "y", "folder"), ("y", "Y", "x", "folder"), ("n", None, "root", "folder")]
    chain = [(f"k{i}", f"n{i}", f"k{i - 1}" if i else "root", "folder") for i in range(12)]
    listing = spark.createDataFrame(tree + chain, SCHEMA)
    asked = ["A/B/C", "A/B", " A / B /", "root/A", "A/B/F", "A/Z/C", "Z", "B", "", "root", "id:b/C", "id:b", "A/B/C", "/".join(f"n{i}" for i in range(12)),
             "/".join(f"n{i}" for i in range(13)), "X"]
    requests = spark.createDataFrame([(p,) for p in asked], "path string").repartition(3)
    assert answers(iv.walk_folders(requests, listing)) == answers(iv.resolve_folders(requests, iv.folder_paths(listing)))
    assert answers(iv.walk_folders(requests, listing.where("id = 'none'")))[:1] != []
    assert iv.walk_folders(requests.where("false"), listing).count() == 0
    assert answers(iv.walk_folders(spark.createDataFrame([("id:nope/Q",), (None,)], "path string"), listing)) == [
        ("id:nope/Q", None, "Q"), (None, "root", None)]
