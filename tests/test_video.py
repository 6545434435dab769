"""Video files through the command line, with programs that stand in for ffmpeg and ffprobe."""

import json
import os
import sys
from pathlib import Path

import pytest

from cinesieve import cli
from cinesieve.operators import detector, sampling
from cinesieve.sources import video

ROOT = Path(__file__).resolve().parents[1]
PROBE = """import sys
name = sys.argv[-1]
if "bad" in name:
    sys.exit(1)
if "-skip_frame" in sys.argv:
    print('{"frames": [{"pts_time": "0.000"}, {"pts_time": "2.5"}, {"pts_time": "5.0"}, {"pts_time": "7.5"}, {"pts_time": "N/A"}, {"pts_time": "10.0"}]}')
    sys.exit()
print('{"streams": [{"width": 40, "height": 40, "r_frame_rate": "4/1"}]}')
"""
#: Four frames a second, 8 dark and then 8 bright ones, or 46 for a long video, whose colour changes at each key frame; images are noise that depends on the video and the frame's time.
CODER = """import math, random, re, sys
sys.path.insert(0, ROOT)
from tests.png import png
args = sys.argv[1:]
name, out = args[args.index("-i") + 1], args[-1]
frames = 0 if "empty" in name else 46 if "long" in name else 16
def image(t):
    r = random.Random(f"{name} {t}")
    return png([[tuple(r.randrange(256) for _ in range(3)) for _ in range(40)] for _ in range(40)])
if out == "-":
    given = lambda flag, default: args[args.index(flag) + 1] if flag in args else default
    filters = given("-vf", "")
    w, h = map(int, re.search(r"scale=(\\d+):(\\d+)", filters).groups()) if "scale" in filters else (40, 40)
    first = round(float(given("-ss", 0)) * 4)
    for i in range(first, frames):
        if (i - first) / 4 >= float(given("-t", 1e9)):
            break
        fps = re.search(r"select='eq\\(n\\+(\\d+),0\\)\\+gt\\(floor\\(\\(n\\+\\d+\\)\\*([\\d.]+)/", filters)
        if fps and i and not math.floor(i * float(fps[2]) / 4) > math.floor((i - 1) * float(fps[2]) / 4):
            continue
        pixel = [20] * 3 if i < 8 or "still" in name else [220] * 3
        pixel = [40 + i, 200 - 40 * (i // 10), 7 * (i // 20)] if "long" in name else pixel
        sys.stdout.buffer.write(bytes(pixel) * (w * h))
elif "-ss" in args:
    open(out, "wb").write(image(float(args[args.index("-ss") + 1])))
else:
    every = 4 / float(args[args.index("-vf") + 1].split("fps=")[1])
    for n, i in enumerate(range(0, frames, round(every)), 1):
        open(out % n, "wb").write(image(i / 4))
"""


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    """Workers that start from here on find the stand-ins first."""
    folder = tmp_path_factory.mktemp("bin")
    for name, code in (("ffprobe", PROBE), ("ffmpeg", CODER.replace("ROOT", repr(str(ROOT))))):
        (folder / name).write_text(f"#!{sys.executable}\n{code}")
        (folder / name).chmod(0o755)
    spark.sparkContext.environment["PATH"] = f"{folder}:{os.environ['PATH']}"
    yield
    del spark.sparkContext.environment["PATH"]


@pytest.fixture
def videos(tmp_path, tools):
    folder = tmp_path / "videos"
    folder.mkdir()
    for name in ("b cut.mp4", "a still.MOV", "bad.mkv", "empty.webm", "notes.txt"):
        (folder / name).write_bytes(b"x")
    return folder


def test_a_batch_of_videos_at_a_rate(spark, tmp_path, videos, capsys):
    assert cli.main(["--batch", str(videos), "--output", str(tmp_path / "out"), "--fps", "2", "--blur", "0", "--sim", "0.9", "--keep-raw"], spark) == 0
    summary = json.loads((tmp_path / "out/_batch_summary.json").read_text())
    assert [(v["index"], v["video_name"], v["status"], v["total_raw_frames"]) for v in summary["video_results"]] == [
        (1, "a still.MOV", "success", 8), (2, "b cut.mp4", "success", 8), (3, "bad.mkv", "error", 0), (4, "empty.webm", "skipped", 0),
    ]
    assert (summary["success"], summary["error"], summary["skipped"], summary["failed"]) == (2, 1, 1, 2)
    assert "ffprobe could not read" in summary["video_results"][2]["error"] and "without success: bad.mkv, empty.webm" in capsys.readouterr().out
    assert len(list((tmp_path / "out/b cut/unique_frames").glob("*.jpg"))) == 8 and len(list((tmp_path / "out/_raw/b cut").glob("*.jpg"))) == 8
    (job,) = [json.loads(p.read_text()) for p in (tmp_path / "out/_jobs").glob("*.json")]
    assert job["status"] == "done" and [x["line"] for x in job["log"]] == ["extract", "curate", "copy", "report"]


def test_one_video_by_scenes(spark, tmp_path, videos):
    assert cli.main(["--input", str(videos / "b cut.mp4"), "--output", str(tmp_path / "out"), "--mode", "scene", "--blur", "0", "--sim", "0.9", "--no-html"], spark) == 0
    assert json.loads((tmp_path / "out/b cut/report.json").read_text())["total_raw_frames"] == 4  # no scene is under 15 frames, so that it is one a second
    assert not (tmp_path / "out/_raw").exists() and not (tmp_path / "out/_batch_summary.json").exists()
    line = video.timeline(spark, [str(videos / n) for n in ("a still.MOV", "b cut.mp4", "bad.mkv")])
    for find in (sampling.cuts, lambda frames, threshold: detector.cuts(frames, threshold, 8)):
        got = sorted((Path(r.key).stem, r.mode, r.t) for r in sampling.sample(line, "scene", find=find).collect())
        assert got == [*[("a still", "fps", t * 1_000_000) for t in range(4)], ("b cut", "scene", 1_000_000), ("b cut", "scene", 2_750_000)]


def results(folder):
    return [(v["video_name"], v["status"], v["total_raw_frames"], Path(v["output_folder"]).parent.name) for v in json.loads((folder / "_batch_summary.json").read_text())["video_results"]]


@pytest.mark.parametrize("mode", [["--fps", "2"], ["--mode", "scene"]])
def test_videos_of_one_stem_and_odd_names_stay_apart(spark, tmp_path, tools, mode):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    names = ["a.mov", "a.mp4", "a.mov.mp4", "cut, one.mp4", "b%20 c+d.mkv"]
    for name in names:
        (folder / name).write_bytes(b"x")
    assert cli.main(["--batch", str(folder), "--output", str(out), *mode, "--blur", "0", "--sim", "0.9", "--no-html", "--keep-raw"], spark) == 0
    keys = {"a.mov": "a.mov", "a.mp4": "a.mp4", "a.mov.mp4": "a.mov.mp4", "cut, one.mp4": "cut, one", "b%20 c+d.mkv": "b%20 c+d"}
    n = 8 if mode[0] == "--fps" else 4
    assert results(out) == [(name, "success", n, keys[name]) for name in sorted(names)]
    summary = json.loads((out / "_batch_summary.json").read_text())
    assert (summary["total_videos"], summary["success"]) == (5, 5)
    for key in keys.values():
        assert len(list((out / key / "unique_frames").glob("*.jpg"))) == n == len(list((out / "_raw" / key).glob("*.jpg")))


def test_a_batch_in_which_every_video_fails(spark, tmp_path, tools, capsys):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for name in ("bad 1.mp4", "bad 2.mp4", "empty.mov"):
        (folder / name).write_bytes(b"x")
    for mode in ("fps", "scene"):
        assert cli.main(["--batch", str(folder), "--output", str(out), "--mode", mode], spark) == 0
        assert [r[1] for r in results(out)] == ["error", "error", "skipped"] and not (out / "_batch_preview.html").exists()
    assert cli.main(["--gen-batch-html", "--output", str(out)], spark) == 0 and "no frames" in capsys.readouterr().out
    assert cli.main(["--input", str(folder / "bad 1.mp4"), "--output", str(tmp_path / "one")], spark) == 1
    assert cli.main(["--input", str(folder / "empty.mov"), "--output", str(tmp_path / "two")], spark) == 0


def test_an_empty_folder_is_a_note(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    assert cli.main(["--batch", str(tmp_path / "in"), "--output", str(tmp_path / "out")], spark) == 0
    assert "note: no videos" in capsys.readouterr().out and not (tmp_path / "out/_batch_summary.json").exists()
    with pytest.raises(SystemExit):
        cli.main(["--gen-batch-html", "--output", str(tmp_path / "none")], spark)


def test_ranges_give_the_same_frames(spark, videos):
    """One partition or five, cut at key frames; every frame or the first of each period."""
    (videos / "long.mp4").write_bytes(b"x")
    (videos / "long two.mp4").write_bytes(b"x")
    video.register(spark)
    paths = json.dumps([str(videos / n) for n in ("long.mp4", "long two.mp4", "bad.mkv")])
    read = lambda **options: spark.read.format("video_frames").options(paths=paths, size="4x2", errors="row", **options).load()
    for fps in (0, 1.5, 3):
        whole, parts = read(fps=fps), read(fps=fps, rangeSeconds=2)
        assert whole.rdd.getNumPartitions() == 3 and parts.rdd.getNumPartitions() == 11
        rows = sorted(map(tuple, whole.collect()), key=str)
        assert rows == sorted(map(tuple, parts.collect()), key=str)
        assert len(rows) == 2 * sum(video._chosen(i, fps, 4.0) for i in range(46)) + 1 and rows[0][3] != rows[-1][3]
    assert read(rangeSeconds=2).where("path LIKE '%long.mp4'").count() == 46
    line = {n: sorted(map(tuple, video.timeline(spark, json.loads(paths), n).collect())) for n in (0, 2, 4)}
    assert line[0] == line[2] == line[4] and len(line[0]) == 92 and sum(r[4] > 40 for r in line[0]) == 8


def test_conditions_reach_the_reader(spark, videos):
    (videos / "long.mp4").write_bytes(b"x")
    video.register(spark)
    paths = json.dumps([str(videos / n) for n in ("long.mp4", "b cut.mp4")])
    read = spark.read.format("video_frames").options(paths=paths, size="4x2", rangeSeconds=2).load()
    one = read.where("video = 'long' AND t_us >= 3000000 AND t_us < 4500000")
    assert one.rdd.getNumPartitions() == 1 and [r.t_us for r in one.orderBy("t_us").collect()] == [3_000_000 + 250_000 * i for i in range(6)]
    assert read.where(f"path IN ('{videos}/b cut.mp4', 'none') AND t_us = 250000").count() == 1 and read.where("video = 'none'").count() == 0
    reader = video._Reader({"paths": paths, "rangeSeconds": "2"})
    assert list(reader.pushFilters([video.GreaterThan(("t_us",), 9_000_000), video.EqualTo(("video",), "long")])) and len(reader.paths) == 1 and reader.least == 9_000_000


def test_hue_saturation_and_brightness():
    import colorsys

    import numpy as np

    from cinesieve.functions import images

    rng = np.random.default_rng(1)
    for b, g, r in [*rng.integers(0, 256, (200, 3)).tolist(), (0, 0, 0), (9, 9, 9), (255, 0, 0), (0, 0, 255), (1, 0, 2)]:
        h, s, v = images.hsv(np.array([[[b, g, r]]], np.uint8))[0, 0].tolist()
        wanted = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
        assert v == max(b, g, r) and abs(s - 255 * wanted[1]) <= 0.51 and min(abs(h - 180 * wanted[0]), 180 - abs(h - 180 * wanted[0])) <= 0.51
