import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinesieve import cli, config
from cinesieve.functions import images
from cinesieve.plans import run
from cinesieve.sources import frames as source
from cinesieve.sources import reports
from tests.png import png

SIDE = 40


def noise(seed):
    r = random.Random(seed)
    return [[tuple(r.randrange(256) for _ in range(3)) for _ in range(SIDE)] for _ in range(SIDE)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("frames")
    a, b = root / "clip a", root / "clip_b"
    a.mkdir(), b.mkdir()
    one, two = noise(1), noise(2)
    near = [row[:] for row in one]
    near[3][3] = (0, 0, 0)
    flat = [[(90, 90, 90)] * SIDE for _ in range(SIDE)]
    for i, pixels in enumerate((one, near, flat, two, one), 1):
        (a / f"frame_{i:05d}.png").write_bytes(png(pixels))
    (a / "frame_00006.png").write_bytes(b"not an image")
    (b / "frame_00001.png").write_bytes(png(two))
    return root


def test_dispositions_scores_and_ranks(spark, folder):
    done = {(r.video, r.frame_order): r for r in run.curate(source.read_frames(spark, str(folder)), config.overridden(config.Config(), top=5)).collect()}
    kinds = {k: r.disposition for k, r in done.items()}
    assert kinds == {
        ("clip a", 1): "unique", ("clip a", 2): "duplicate", ("clip a", 3): "blurry", ("clip a", 4): "unique", ("clip a", 5): "duplicate",
        ("clip a", 6): "blurry", ("clip_b", 1): "unique",
    }
    assert done["clip a", 5].similarity == 1.0
    assert done["clip a", 6].blur_score == 0
    assert {k for k, r in done.items() if r.scores} == {k for k, kind in kinds.items() if kind == "unique"}  # survivors alone
    assert sorted(r.rank for k, r in done.items() if k[0] == "clip a" and r.rank) == [1, 2]
    off = run.curate(source.read_frames(spark, str(folder)), config.Config())
    assert off.where("scores IS NOT NULL OR rank IS NOT NULL").isEmpty() and off.where("unique_no IS NOT NULL").count() == 3


def test_unreadable_frames_at_threshold_zero(spark, folder):
    settings = config.overridden(config.Config(), blur=0)
    kinds = {r.frame_order: r.disposition for r in run.curate(source.read_frames(spark, str(folder)), settings).where("video = 'clip a'").collect()}
    assert kinds[6] == "hash_error" and kinds[3] == "unique"
    by_structure = config.overridden(config.Config(), blur=0, method="ssim", sim=0.9)
    kinds = {r.frame_order: r.disposition for r in run.curate(source.read_frames(spark, str(folder)), by_structure).where("video = 'clip a'").collect()}
    assert kinds == {1: "unique", 2: "duplicate", 3: "unique", 4: "unique", 5: "duplicate", 6: "unreadable"}


def test_batch_outputs_and_readers(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["--batch", str(folder), "--output", out, "--top", "1"], spark) == 0
    report = json.loads((tmp_path / "out/clip a/report.json").read_text())
    assert list(report)[:6] == ["video", "generated_at", "total_raw_frames", "removed_blurry", "removed_duplicate", "final_unique_frames"] and len(report) == 17
    assert (report["total_raw_frames"], report["removed_blurry"], report["removed_duplicate"], report["final_unique_frames"]) == (6, 2, 2, 2)
    assert report["reduction_rate"] == "66.7%" and report["top_n_requested"] == 1 and report["top_n_selected"] == 1
    assert [d["file"] for d in report["duplicate_files_removed"]] == ["frame_00002.png", "frame_00005.png"]
    scores = json.loads((tmp_path / "out/clip a/score_report.json").read_text())
    assert len(scores) == 2 and scores[0]["total"] >= scores[1]["total"] and "error" not in scores[0]
    assert sorted(p.name for p in (tmp_path / "out/clip a/unique_frames").glob("*.png")) == ["unique_0000.png", "unique_0001.png"]
    assert (tmp_path / "out/clip a/unique_frames/unique_0000.png").read_bytes() == (folder / "clip a/frame_00001.png").read_bytes()
    assert "data:image/png;base64," in (tmp_path / "out/clip a/preview.html").read_text()
    assert "clip%20a/unique_frames/unique_0000.png" in (tmp_path / "out/_batch_preview.html").read_text()
    stats = reports.batch_stats(reports.batch_results(spark, out)).first()
    assert (stats.total_videos, stats.total_raw_frames, stats.final_unique_frames) == (2, 7, 3)
    (tmp_path / "out/_batch_summary.json").unlink()
    assert reports.batch_stats(reports.batch_results(spark, out)).first().total_raw_frames == 7
    assert reports.report(spark, out, "clip a").first().final_unique_frames == 2
    assert reports.report(spark, out, "nothing") is None and reports.downloaded(spark, out) is None
    (tmp_path / "out/broken").mkdir()
    (tmp_path / "out/broken/report.json").write_text("{")
    with pytest.raises(Exception, match="MALFORMED"):
        reports.report(spark, out, "broken").collect()
    assert reports.reports(spark, out).count() == 2
    assert cli.main(["--gen-batch-html", "--output", out], spark) == 0
    (tmp_path / "out/other").mkdir()
    (tmp_path / "out/other/notes.txt").write_text("x")
    assert cli.main(["--clean-empty", "--output", out], spark) == 0
    assert "other" in capsys.readouterr().out.split("\n")
    assert (tmp_path / "out/other/notes.txt").exists()


def test_folders_without_frames_are_rows_of_the_summary(spark, folder, tmp_path, capsys):
    import shutil

    shutil.copytree(folder, tmp_path / "in")
    (tmp_path / "in/a first").mkdir()
    out = str(tmp_path / "out")
    (tmp_path / "out/clip_b/unique_frames").mkdir(parents=True)
    (tmp_path / "out/clip_b/unique_frames/unique_0007.png").write_bytes(b"of an earlier run")
    assert cli.main(["--input", str(tmp_path / "in"), "--output", out, "--fps", "2"], spark) == 0  # a folder is a batch
    summary = json.loads((tmp_path / "out/_batch_summary.json").read_text())
    assert [(v["index"], v["video_name"], v["status"], v["total_raw_frames"]) for v in summary["video_results"]] == [(1, "a first", "skipped", 0), (2, "clip a", "success", 6), (3, "clip_b", "success", 1)]
    assert (summary["total_videos"], summary["success"], summary["skipped"], summary["failed"]) == (3, 2, 1, 1) and "No frames" in summary["video_results"][0]["error"]
    assert [p.name for p in (tmp_path / "out/clip_b/unique_frames").glob("*.png")] == ["unique_0000.png"]
    said = capsys.readouterr().out
    assert "extracted already" in said and "without success: a first" in said and not (tmp_path / "out/clip a/score_report.json").exists()
    assert cli.main(["--input", str(folder / "clip a"), "--output", str(tmp_path / "one")], spark) == 0
    assert json.loads((tmp_path / "one/clip a/report.json").read_text())["final_unique_frames"] == 2
    for wrong in (["--input", str(tmp_path / "none")], ["--batch", str(folder / "clip a/frame_00001.png")]):
        with pytest.raises(SystemExit):
            cli.main([*wrong, "--output", out], spark)


def test_jobs_are_rows(spark, folder, tmp_path):
    from cinesieve.plans import jobs

    assert jobs.recent(spark, str(tmp_path)).collect() == []
    with jobs.Job(spark, str(tmp_path), "a") as job:
        job.step("one")
        assert [(r.status, r.step) for r in jobs.recent(spark, str(tmp_path)).collect()] == [("running", "one")]
        job.step("two")
    with pytest.raises(ValueError), jobs.Job(spark, str(tmp_path), "b"):
        raise ValueError("no")
    rows = jobs.recent(spark, str(tmp_path)).collect()
    assert [(r.source, r.status, r.error) for r in rows] == [("b", "error", "ValueError: no"), ("a", "done", None)]
    assert jobs.recent(spark, str(tmp_path), 1).first().source == "b"
    jobs.evict(spark, str(tmp_path), 1)
    assert [r.source for r in jobs.jobs(spark, str(tmp_path)).collect()] == ["b"] and len(list((tmp_path / "_jobs").glob("[!.]*"))) == 2
    with jobs.Job(spark, str(tmp_path), "c") as job:
        job.step("one")
        job.step("two")
    rows = jobs.recent(spark, str(tmp_path)).where("source = 'c'").collect()
    assert [r.line for r in jobs.log(spark, str(tmp_path), rows[0].job_id).collect()] == ["one", "two"] and jobs.recent(spark, str(tmp_path), 1).count() == 1


def test_survivors_alone_are_read_again(spark, folder, tmp_path, monkeypatch):
    import shutil

    shutil.copytree(folder, tmp_path / "in")
    odd = tmp_path / "in/c [1] {x,y}*"
    odd.mkdir()
    for i in (1, 2):
        shutil.copy(folder / f"clip a/frame_0000{3 * i - 2}.png", odd / f"frame?%20{i}.png")
    read = []
    monkeypatch.setattr(source, "read_images", lambda *a, of=source.read_images: read.append(df := of(*a)) or df)
    monkeypatch.setattr(run, "LISTED", 2)
    done = run.curate(source.read_frames(spark, str(tmp_path / "in")), config.overridden(config.Config(), top=5))
    unique = {r.origin for r in done.where("disposition = 'unique'").collect()}
    assert len(unique) == 5 and sorted(len(df.inputFiles()) for df in read) == [1, 2, 2]
    assert sorted(r.origin for df in read for r in df.collect()) == sorted(unique)
    assert done.where("scores.total > 0").count() == 5 and done.where("scores IS NOT NULL").count() == 5


def test_files_are_copied_by_the_tasks(spark, tmp_path):
    from cinesieve.sinks import files

    (tmp_path / "a b").write_bytes(b"x" * 3_000_000)
    out = tmp_path / "to"
    rows = spark.createDataFrame([(f"file:{tmp_path}/a b", f"{out}/{i}/c d") for i in range(5)], "src string, dest string")
    bad = rows.union(spark.createDataFrame([(f"{tmp_path}/none", f"{out}/e")], rows.schema))
    with pytest.raises(OSError, match="1 files could not"):
        files.copy(bad, str(out))
    assert not list(out.iterdir())  # not one of the others, no part
    assert files.copy(rows, str(out)) == 5 and all((out / f"{i}/c d").stat().st_size == 3_000_000 for i in range(5))
    assert sorted(p.name for p in out.iterdir()) == list("01234")
    large = files.commit(rows.select(F.col("dest").alias("path"), "src"), lambda row: files.chunks_of(row["src"]), str(out), 2 << 20)
    assert large[0] == 5 and large[1][0].endswith("has 2 MB")
    assert files.copy(rows.limit(0), str(out)) == 0 and sorted(p.name for p in out.iterdir()) == list("01234")
    files._move(f"{out}/moved before", f"{out}/0/c d")  # a task that is tried again
    with pytest.raises(OSError):
        files._move(f"{out}/moved before", f"{out}/0/none")


def test_lost_tries_of_tasks_leave_nothing(spark, tmp_path):
    from cinesieve.sinks import files

    rows = spark.createDataFrame([(f"{tmp_path}/out/{i}", str(i)) for i in range(4)], "path string, text string").repartition(2)
    noted = str(tmp_path / "tries")

    def content(row):
        """A part is begun twice: the first try ends in the middle of it."""
        with open(noted, "a") as f:
            f.write(row["text"])
        yield row["text"].encode()
        if open(noted).read().count(row["text"]) == 1:
            raise OSError("lost")

    with pytest.raises(OSError, match="4 files"):
        files.commit(rows, content, str(tmp_path / "out"))
    assert not list((tmp_path / "out").iterdir())
    assert files.commit(rows, content, str(tmp_path / "out"))[0] == 4
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {str(i): str(i) for i in range(4)}


def test_page_over_a_batch_is_cut_by_ranges(spark, tmp_path):
    from html import escape
    from urllib.parse import quote

    from cinesieve.sinks import reports as pages

    names = {"a & b": ["unique_0001.png", "unique_0000.png", "u~*+ (1)'é.jpg"], "c<d>": [f"unique_{i:04d}.jpg" for i in range(1200)], "z": ["50%.png"]}
    rows = [(v, f, int(f.endswith("png"))) for v, own in names.items() for f in own]
    shown = spark.createDataFrame(rows, "video string, file string, kind int").repartition(7)
    page = pages.write_gallery(spark, shown, str(tmp_path))
    body = ""
    for video, own in names.items():
        files = sorted(own, key=lambda f: (f.endswith("png"), f))
        figures = [f'<figure><img loading="lazy" src="{quote(f"{video}/unique_frames/{f}")}" alt=""><figcaption>{i:03d} {escape(f)}</figcaption></figure>' for i, f in enumerate(files, 1)]
        body += f'<h2>{escape(video)} ({len(own)})</h2><div class="g">' + "\n".join(figures) + "</div>\n"
    text = open(page, encoding="utf-8").read()
    assert text.split("\n", 1)[0].endswith("<h1>3 videos, 1204 frames</h1>") and text.split("\n", 1)[1] == body
    assert [p.name for p in tmp_path.iterdir()] == ["_batch_preview.html"]
    assert pages.write_gallery(spark, shown.limit(0), str(tmp_path / "none")) is None and not (tmp_path / "none").exists()


def test_names_without_numbers_stay_apart(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for i, name in enumerate(("b.png", "a.png", "a.jpg")):
        (tmp_path / "v" / name).write_bytes(png(noise(i)))
    rows = run.curate(source.read_frames(spark, str(tmp_path)), config.Config()).orderBy("frame_order").collect()
    assert [(r.frame_order, r.file) for r in rows] == [(1, "a.jpg"), (2, "a.png"), (3, "b.png")]


def test_video_source_says_what_is_missing(spark):
    from cinesieve.sources import video

    video.register(spark)
    with pytest.raises(Exception, match="ffmpeg"):
        spark.read.format("video_frames").option("path", "/none.mp4").load().collect()


def test_video_listing(spark, tmp_path):
    for name in ("b.MP4", "a.mov", "notes.txt", ".mp4"):
        (tmp_path / name).write_bytes(b"x")
    assert [(r.video, r["index"]) for r in source.videos(spark, str(tmp_path)).orderBy("index").collect()] == [("a", 1), ("b", 2)]


def test_closed_forms():
    flat = np.full((9, 9, 3), 77, np.uint8)
    s = images.scores(flat)
    assert (s["sharpness"], s["contrast"], s["composition"], s["colorfulness"]) == (0.0, 0.0, 0.0, 0.0)
    assert s["brightness"] == round(1 - 51 / 128, 3)
    red = np.zeros((4, 4, 3), np.uint8)
    red[:, :, 2] = 255
    assert images.scores(red)["colorfulness"] == 1.0
    dot = np.zeros((9, 9), np.uint8)
    dot[4, 4] = 255
    assert abs(images.laplacian_variance(dot) - 255**2 * 20 / 81) < 1e-6
    board = np.indices((8, 8)).sum(axis=0) % 2 * 255
    assert images.scores(np.repeat(board[:, :, None].astype(np.uint8), 3, axis=2))["contrast"] == 1.0


def test_edges_of_a_square():
    img = np.zeros((32, 32), np.uint8)
    img[12:20, 12:20] = 255
    e = images.edges(img) > 0
    assert e.any() and not e[:10].any() and not e[22:].any() and not e[15:17, 15:17].any()
    assert images.composition(img) == 1.0
    img = np.zeros((32, 32), np.uint8)
    img[:, 2:] = 255
    assert images.composition(img) == 0.0


def reached(gray, low=images.EDGE_LOW, high=images.EDGE_HIGH):
    """Edges with everything weak, and those of them that a walk from the strong ones reaches."""
    weak, found = images.edges(gray, low, low) > 0, images.edges(gray, high, high) > 0
    todo = list(zip(*np.nonzero(found), strict=True))
    while todo:
        y, x = todo.pop()
        for at in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if 0 <= at[0] < weak.shape[0] and 0 <= at[1] < weak.shape[1] and weak[at] and not found[at]:
                found[at] = True
                todo.append(at)
    return found


def spiral(side=80, faint=140):
    """A line wound up from the border to the middle, faint but for its last steps."""
    img = np.full((side, side), 100, np.uint8)
    for turn in np.linspace(8 * np.pi, 0.5, 6000):
        y, x = (int(side / 2 + turn * 1.4 * f(turn)) for f in (np.sin, np.cos))
        img[y : y + 3, x : x + 3] = faint if turn > 6 else 255
    return img


def test_weak_edges_are_kept_where_strong_ones_reach_them():
    rng = np.random.default_rng(3)
    for gray in [*rng.integers(60, 140, (20, 24, 24), np.uint8), *rng.integers(0, 256, (5, 8, 8), np.uint8)]:
        assert ((images.edges(gray) > 0) == reached(gray)).all()
    line, high = spiral(), 500
    whole, faint = images.edges(line, high=high) > 0, np.minimum(line, 140)
    assert (whole == reached(line, high=high)).all() and not images.edges(faint, high=high).any()
    assert whole.sum() > 700 and whole[:14].any() and whole[-14:].any()  # the outer turns are reached from the middle alone


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"_comment": "x", "filter": {"blur_threshold": 10, "_n": 1}, "scorer": null, "output": 3}')
    loaded = config.load(spark, str(tmp_path / "c.json"))
    assert loaded.filter.blur_threshold == 10 and loaded.scorer.top_n == 30 and len(loaded.warnings) == 1
    (tmp_path / "bad.json").write_text("{")
    assert config.load(spark, str(tmp_path / "bad.json")).filter == config.Filter() and config.load(spark, str(tmp_path / "none.json")).warnings
    changed = config.overridden(loaded, fps=-1, blur=-2, sim=1.0, top=0, no_html=True)
    assert changed.filter == loaded.filter and not changed.scorer.enabled and not changed.output.generate_html_preview and len(changed.warnings) == 5
    assert config.overridden(loaded, top=3).scorer.enabled
