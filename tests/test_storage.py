from lexispan.operators import storage as ST

KEY, OTHER = "clp_" + "a" * 20, "clp_" + "b" * 20


def test_each_file_has_one_class(spark, tmp_path):
    tree = {
        "raw/audio/es/v1/manifest.json": "raw_manifest", "raw/audio/es/v1/a.m4a": "raw_source", "raw/audio/es/v1/b.part": "unrecognized", "raw/audio/es/v1/x/a.m4a": "unrecognized",
        "raw/audio/es/v2/manifest.json": "raw_manifest", "raw/audio/es/v2/a.m4a": "unrecognized", "raw/audio/es/gone/a.m4a": "orphan",
        f"derived/audio/clips/es/v1/{KEY}/manifest.json": "clip_manifest", f"derived/audio/clips/es/v1/{KEY}/c.ogg": "clip", f"derived/audio/clips/es/v1/{KEY}/d.ogg": "unrecognized",
        f"derived/audio/clips/es/v1/{OTHER}/c.ogg": "invalid_manifest", "derived/audio/clips/es/v1/odd/c.ogg": "unrecognized", f"derived/audio/clips/de/v9/{KEY}/c.ogg": "orphan", "notes.txt": None,
    }
    for k, path in enumerate(tree):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * (k + 1))
    videos = spark.createDataFrame([("es", "v1", "c1"), ("es", "v2", "c1"), ("es", "v3", None)], "language string, video_key string, channel string")
    raw = spark.createDataFrame([("es", "v1", "ready", "a.m4a"), ("es", "v2", "failed", "a.m4a")], "language string, video_key string, status string, source_file string")
    clips = spark.createDataFrame([("es", "v1", KEY, "c.ogg")], "language string, video_key string, clip_key string, clip_file string")
    files = ST.classified(ST.listing(spark, str(tmp_path)), videos, raw, clips)
    assert {r["path"]: r["class"] for r in files.collect()} == tree
    total = ST.usage(files, videos, raw).where("level = 3").first()
    assert (total["videos"], total["ready"], total["failed"], total["missing"]) == (3, 1, 1, 1)
    assert (total["raw_files"], total["raw_bytes"], total["derived_clips"], total["derived_bytes"]) == (3, 1 + 2 + 5, 1, 8 + 9)
    assert ST.usage(files, videos, raw).where("level = 0").count() == 2
    found = {(r["language"], r["class"]): r["files"] for r in ST.issues(files).collect()}
    assert found == {("es", "unrecognized"): 5, ("es", "orphan"): 1, ("es", "invalid_manifest"): 1, ("de", "orphan"): 1}
    assert ST.classified(files.select("path", "bytes").limit(0), videos, raw, clips).collect() == []
