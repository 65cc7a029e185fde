import gzip
import io
import lzma
import random
import re
import subprocess
import sys
import warnings
from pathlib import Path

import pytest
from conftest import final_plan

import hangstats as hs
from hangstats.catalog.layouts import layout
from hangstats.constants import DIMENSIONS
from hangstats.session import scratch_dir, shared_folder
from hangstats.sources import xz
from hangstats.sources.files import selected_files
from hangstats.sources.lines import _stream_pieces, part_lines, split_lines
from hangstats.sources.listing import (
    FilePart,
    ReportFile,
    ReportTree,
    arrow_uri,
    deal,
    head,
    plan_slices,
    read_slices,
)

DAYS = ("20141105", "20141106", "20141107")


def folder(root, version="36.0", day="20141106", channel="nightly", reason="saved-session"):
    values = (reason, "App", channel, version, "20141101030201", day)
    path = Path(root, *[f"{name}={value}" for name, value in zip(DIMENSIONS, values)])
    path.mkdir(parents=True, exist_ok=True)
    return path


def texts(frame):
    return sorted(row.value for row in frame.collect())


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """One file for each of 3 days, 2 versions and 2 channels, and of another reason."""
    root = tmp_path_factory.mktemp("files")
    for day in DAYS:
        for version in ("36.0", "36.0a1"):
            for channel in ("nightly", "beta"):
                place = folder(root, version, day, channel)
                content = f"{channel} {version} {day}\n".encode()
                (place / "a.lzma").write_bytes(lzma.compress(content, format=lzma.FORMAT_ALONE))
        (folder(root, day=day, reason="idle-daily") / "a.xz").write_bytes(lzma.compress(b"idle\n"))
    return str(root)


@pytest.mark.parametrize(
    "chosen, expected",
    [
        (hs.PingFilter("App", "nightly"), 6),
        (hs.PingFilter("App", "nightly", "36.0"), 3),
        (hs.PingFilter("App", "nightly", "36.0", "*", "20141106"), 1),
        (hs.PingFilter("App", "nightly", ("36.0", "36.0"), "*", ("20141106", "20141107")), 2),
        (hs.PingFilter("App", "nightly", ("36.0", "36.0a0"), "*", "*"), 3),
        (hs.PingFilter("App", "nightly", ("*", "*"), ("*", "*"), ("*", "20141105")), 2),
        (hs.PingFilter("App", "nightly", "*", "*", ("20141107", "*")), 2),
        (hs.PingFilter("App", "beta", "*", ("20141101000000", "20141102"), "20141106"), 2),
        (hs.PingFilter("App", "beta", "*", ("2014110104", "20141102"), "20141106"), 0),
        (hs.PingFilter("Other", "nightly"), 0),
    ],
)
def test_selection(spark, root, chosen, expected):
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        lines = hs.read_lines(spark, root, chosen)
    assert lines.count() == expected
    assert bool(caught) == (expected == 0)
    assert lines.columns == ["value", *DIMENSIONS]
    assert all(field.dataType.simpleString() == "string" for field in lines.schema)


def test_dimensions_stay_text(spark, root):
    lines = hs.read_lines(spark, root, hs.PingFilter("App", "nightly", "36.0", "*", "20141106"))
    row = lines.first()
    assert (row.appVersion, row.submission_date, row.value) == (
        "36.0",
        "20141106",
        "nightly 36.0 20141106",
    )


def test_only_matching_directories_are_listed(root, monkeypatch):
    tree = ReportTree(root)
    chosen = hs.PingFilter("App", "nightly", "36.0", "*", ("20141106", "20141107"))
    found = tree.directories(chosen)
    assert [d.dimensions[-1] for d in found] == ["20141106", "20141107"]
    # The root and one directory on each level: other reasons, channels and versions are not looked into.
    assert len(tree.listed) == len(DIMENSIONS) == len(set(tree.listed))
    assert not any("idle-daily" in path or "beta" in path or "36.0a1" in path for path in tree.listed)
    assert [len(files) for files in tree.contents(found)] == [1, 1]
    assert len(tree.listed) == len(DIMENSIONS) + 2


@pytest.mark.parametrize("compressed", [True, False])
def test_reading_lists_each_directory_once(spark, root, monkeypatch, compressed):
    trees = []
    build = ReportTree.__init__
    monkeypatch.setattr(ReportTree, "__init__", lambda self, uri: (build(self, uri), trees.append(self))[0])
    lines = hs.read_lines(spark, root, hs.PingFilter("App", "nightly", "36.0"), compressed=compressed)
    if compressed:
        assert lines.count() == 3
    (tree,) = trees
    # Levels down to the version, three days; and the content of the days where it is dealt to tasks.
    assert len(tree.listed) == len(set(tree.listed)) == len(DIMENSIONS) + 3 * compressed


def test_text_files_of_chosen_directories(spark, tmp_path):
    for day in DAYS:
        (folder(tmp_path, day=day) / "a.txt").write_bytes(f"{day}\n".encode())
    lines = hs.read_lines(spark, str(tmp_path), hs.PingFilter("App", "nightly", submission=DAYS[1]), compressed=False)
    assert [(r.value, r.submission_date) for r in lines.collect()] == [(DAYS[1], DAYS[1])]
    assert files_read(lines) == 1


def files_read(frame):
    """The number of files the (only) scan of a frame opened."""
    frame = frame.select("*")  # a plan that has not run yet
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().apply("numFiles").value()


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.5, 0.99, 1.0, 2.0])
@pytest.mark.parametrize("chosen", [None, hs.PingFilter("App", "nightly")])
def test_head_fraction_of_files(spark, root, fraction, chosen):
    files = selected_files(spark, root, chosen)
    names = [(file.path.rsplit("/", 1)[0], file.path) for file in files]
    assert names == sorted(names)
    kept = files[: int(len(files) * fraction)]
    assert selected_files(spark, root, chosen, fraction) == kept
    lines = hs.read_lines(spark, root, chosen, fraction)
    days = sorted(file.dimensions[-1] for file in kept)
    assert sorted(row.submission_date for row in lines.collect()) == days


def test_head_looks_into_one_directory():
    class Counted(str):
        compared = 0

        def __lt__(self, other):
            Counted.compared += 1
            return str.__lt__(self, other)

    rng = random.Random(5)
    contents = []
    for d in range(30):
        names = [Counted(f"/d{d:02d}/{i:07d}") for i in range(rng.randrange(0, 200))]
        rng.shuffle(names)
        contents.append([ReportFile(name, 1, ()) for name in names])
    everything = [file for files in contents for file in sorted(files, key=lambda f: str(f.path))]
    for fraction in (0.0, 0.013, 0.31, 0.5, 0.999, 1.0, 1.5):
        Counted.compared = 0
        kept = head(contents, fraction)
        boundary = max((len(files) for files in contents), default=0)
        assert Counted.compared <= 20 * boundary
        wanted = everything[: int(len(everything) * fraction)]
        assert sorted(str(f.path) for files in kept for f in files) == [str(f.path) for f in wanted]


def test_a_million_names_in_one_directory():
    contents = [[ReportFile(f"/a/{i * 7919 % 1_000_003:07d}", 1, ()) for i in range(1_000_003)], []]
    kept = head(contents, 0.001)
    assert sorted(f.path for f in kept[0]) == [f"/a/{i:07d}" for i in range(1000)]


def test_listing_opens_no_file(spark, tmp_path):
    (folder(tmp_path) / "broken.lzma").write_bytes(b"no lzma at all")
    (folder(tmp_path) / "_part-1").write_bytes(b"not complete")
    assert len(selected_files(spark, str(tmp_path))) == 1
    with pytest.raises(Exception, match="LZMAError|format"):
        hs.read_lines(spark, str(tmp_path)).collect()


def test_odd_directories(spark, tmp_path):
    (folder(tmp_path) / "a.xz").write_bytes(lzma.compress(b"kept\n"))
    (folder(tmp_path, version="1%3A2 x") / "a.xz").write_bytes(lzma.compress(b"escaped\n"))
    (folder(tmp_path, version="__HIVE_DEFAULT_PARTITION__") / "a.xz").write_bytes(lzma.compress(b"none\n"))
    (Path(tmp_path) / "stray=1").mkdir()
    (Path(tmp_path) / "reason=saved-session" / "stray.xz").write_bytes(lzma.compress(b"stray\n"))
    found = {r.value: r.appVersion for r in hs.read_lines(spark, str(tmp_path)).collect()}
    assert found == {"kept": "36.0", "escaped": "1:2 x", "none": None}
    held = hs.read_lines(spark, str(tmp_path), hs.PingFilter("App", "nightly", ("1", "2")))
    assert texts(held) == ["escaped"]


def test_the_scan_is_a_stream(spark, root):
    plan = final_plan(hs.read_lines(spark, root))
    assert "content" not in plan and "Exchange" not in plan and "Scan" not in plan
    assert plan.count("MapInArrow") == plan.count("Range (0") == 1


@pytest.mark.parametrize("name", ["hang_clusters", "plugin_hang_median", "top_plugin_stacks", "all_reports"])
def test_files_are_read_once(spark, sf_dir, name):
    """What an analysis shuffles twice is one shuffle over files as well."""
    lines = hs.read_lines(spark, layout(spark, sf_dir, "lzma"))
    plan = final_plan(getattr(hs, name)(hs.read_reports(lines)))
    assert plan.count("MapInArrow") == 1
    assert len(re.findall(r"AS _report#", plan)) == 1


def test_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        hs.read_lines(spark, f"{tmp_path}/nothing").collect()


def test_codecs_and_line_ends(spark, tmp_path):
    place = folder(tmp_path)
    content = "one\r\ntwo\rthree\n\nfünf".encode()
    (place / "a.lzma").write_bytes(lzma.compress(content, format=lzma.FORMAT_ALONE))
    (place / "b.xz").write_bytes(lzma.compress(content) + lzma.compress(b"more"))
    (place / "c.xz").write_bytes(lzma.compress(b""))
    (place / "ignored.txt").write_bytes(b"not compressed")
    found = texts(hs.read_lines(spark, str(tmp_path)))
    assert found == sorted(["one", "two", "three", "", "fünf", "one", "two", "three", "", "fünfmore"])


def test_text_and_gzip(spark, tmp_path):
    place = folder(tmp_path)
    (place / "a.txt").write_bytes(b"one\r\ntwo")
    (place / "b.gz").write_bytes(gzip.compress(b"three\nfour\n"))
    lines = hs.read_lines(spark, str(tmp_path), compressed=False)
    assert texts(lines) == ["four", "one", "three", "two"]
    assert lines.first().appVersion == "36.0"
    half = hs.read_lines(spark, str(tmp_path), fraction=0.5, compressed=False)
    assert texts(half) == ["one", "two"]
    assert files_read(half) == 1


def test_text_that_is_not_utf8(spark, tmp_path):
    (folder(tmp_path) / "a.xz").write_bytes(lzma.compress(b"ok\nb\xffd\n"))
    assert texts(hs.read_lines(spark, str(tmp_path))) == ["b�d", "ok"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
def test_lines_at_piece_borders(chunk):
    rng = random.Random(chunk)
    for _ in range(40):
        text = "".join(rng.choice(["a", "bc", "\n", "\r", "\r\n"]) for _ in range(rng.randrange(30)))
        pieces = _stream_pieces(io.BytesIO(lzma.compress(text.encode())), chunk)
        lines = [line.decode() for part in split_lines(pieces) for line in part]
        assert lines == text.replace("\r\n", "\n").replace("\r", "\n").splitlines()


def test_long_line_over_many_pieces():
    text = b"x" * 100_000 + b"\r\n" + b"y" * 50_000 + b"\rz\r"
    for chunk in (1, 7, 1000):
        pieces = _stream_pieces(io.BytesIO(lzma.compress(text)), chunk)
        assert [line for part in split_lines(pieces) for line in part] == [b"x" * 100_000, b"y" * 50_000, b"z"]


# --- slices ----------------------------------------------------------------


def test_slices(spark, root):
    assert [read_slices(n, 8) for n in (0, 100, 128, 160, 1600)] == [8, 8, 8, 10, 100]
    lines = hs.read_lines(spark, root)
    assert lines.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert hs.read_lines(spark, root, fraction=0.5).count() == 7


def test_slices_are_alike_in_bytes():
    rng = random.Random(1)
    sizes = [5_000] + [rng.randrange(1, 100) for _ in range(2_000)]
    parts = [FilePart(f"/{i}", size, ()) for i, size in enumerate(sizes)]
    dealt = deal(parts, 10)
    assert sorted(p for one in dealt for p in one) == sorted(parts)
    loads = sorted(sum(p.size for p in one) for one in dealt)
    # The large file, which cannot be split, has a slice more or less to itself; the rest is even.
    mean = sum(sizes) / 10
    assert loads[-1] <= max(mean, 5_000) + 100
    assert loads[-1] - loads[0] <= 100
    large = [FilePart("/l", 50_000, ()), *parts[1:]]
    loads = sorted(sum(p.size for p in one) for one in deal(large, 10))
    assert loads[-1] == 50_000 and loads[-2] - loads[0] <= 100


# --- XZ in the middle --------------------------------------------------------


def multi_block(pieces, check=lzma.CHECK_CRC64):
    """One stream with a block for each piece, put together from single-block streams."""
    streams = [lzma.compress(piece, check=check) for piece in pieces if piece]
    parsed = [xz.read_blocks(io.BytesIO(stream))[0] for stream in streams]
    body = b"".join(s[b.offset : b.offset + b.size] for s, b in zip(streams, parsed))

    def number(n):
        out = b""
        while n >= 0x80:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    import struct
    import zlib

    records = b""
    for s in streams:
        index_size = (struct.unpack("<I", s[-8:-4])[0] + 1) * 4
        (unpadded, text), _ = xz._numbers(s[-12 - index_size : -12], 2, 2)
        records += number(unpadded) + number(text)
    index = b"\0" + number(len(streams)) + records
    index += b"\0" * (-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + streams[0][6:8]
    return streams[0][:12] + body + index + struct.pack("<I", zlib.crc32(tail)) + tail + b"YZ"


def all_parts(data, share):
    blocks = xz.read_blocks(io.BytesIO(data))
    return blocks, xz.cuts(blocks, share)


@pytest.mark.parametrize("seed", range(60))
def test_parts_of_a_file_have_each_line_once(seed):
    """Lines across blocks, line ends at borders, empty lines, \r\n in two blocks, several streams."""
    rng = random.Random(seed)
    pieces = [
        "".join(rng.choice(["a", "bc", "\n", "\r", "\r\n", "x" * 30]) for _ in range(rng.randrange(1, 9))).encode()
        for _ in range(rng.randrange(1, 12))
    ]
    middle = rng.randrange(len(pieces) + 1)
    groups = [group for group in (pieces[:middle], pieces[middle:]) if group]
    data = b"".join(multi_block(group) + b"\0" * 4 * rng.randrange(3) for group in groups)
    whole = b"".join(pieces)
    blocks, cuts = all_parts(data, rng.choice([1, 60, 200]))
    assert [b.text for b in blocks] == [len(piece) for piece in pieces]
    lines = []
    for first, last, _ in cuts:
        length = sum(b.text for b in blocks[first:last]) if last < len(blocks) else None
        text = xz.block_text(io.BytesIO(data), blocks[first:])
        lines += [line for part in split_lines(xz.owned(text, first == 0, length)) for line in part]
    assert lines == whole.splitlines()


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(9)
    lines = [f"{i}-{rng.getrandbits(400):x}" for i in range(20_000)]
    text = ("\n".join(lines) + "\n").encode()
    cut = 65_537
    pieces = [text[i : i + cut] for i in range(0, len(text), cut)]
    path = folder(tmp_path) / "large.xz"
    path.write_bytes(multi_block(pieces))
    assert lzma.decompress(path.read_bytes()) == text
    (folder(tmp_path, day=DAYS[0]) / "small.xz").write_bytes(lzma.compress(b"small\n"))
    tree = ReportTree(str(tmp_path))
    files = [f for one in tree.contents(tree.directories()) for f in one]
    slices = plan_slices(tree, files, 8)
    assert len(slices) >= 7
    loads = [sum(p.size for p in one) for one in slices]
    assert max(loads) < 2 * sum(loads) / 8
    found = hs.read_lines(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == len(slices)
    assert texts(found) == sorted([*lines, "small"])
    one_task = FilePart(str(path), 0, ())
    assert [x.decode() for part in part_lines(tree.files, one_task) for x in part] == lines


def test_files_that_cannot_be_entered(tmp_path):
    (folder(tmp_path) / "one_block.xz").write_bytes(lzma.compress(random.Random(1).randbytes(50_000)))
    (folder(tmp_path) / "alone.lzma").write_bytes(lzma.compress(b"x\n" * 9, format=lzma.FORMAT_ALONE))
    tree = ReportTree(str(tmp_path))
    files = [f for one in tree.contents(tree.directories()) for f in one]
    assert sorted(p.last for one in plan_slices(tree, files, 8) for p in one) == [-1, -1]
    with pytest.raises(xz.NotXZ):
        xz.read_blocks(io.BytesIO(b"no xz file at all, but long enough"))
    with pytest.raises(xz.NotXZ):
        xz.read_blocks(io.BytesIO(lzma.compress(b"abc")[:-5]))


def test_memory_does_not_follow_the_size_of_a_file(tmp_path):
    """A file of 600 MB of text is read with a few tens of MB."""
    path = tmp_path / "long.xz"
    with lzma.open(path, "wb", preset=0) as out:
        for _ in range(600):
            out.write(b"a line of some length that compresses well\n" * 24_000)
    script = f"""
import resource
from pyarrow import fs
from hangstats.sources.lines import part_lines
from hangstats.sources.listing import FilePart
files = fs.LocalFileSystem()
def peak():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
before = peak()
n = sum(len(part) for part in part_lines(files, FilePart({str(path)!r}, 0, ())))
print(n, (peak() - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True)
    n, grown = map(int, done.stdout.split())
    assert n == 600 * 24_000
    assert grown < 100


def test_arrow_paths(spark):
    assert arrow_uri(spark, "/some/where") == "/some/where"
    assert arrow_uri(spark, "file:///some/where") == "/some/where"


def test_scratch_folder_follows_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    if before:
        assert scratch_dir(spark, "x").startswith(before.rstrip("/"))


@pytest.mark.parametrize(
    ("master", "named", "warehouse", "folder"),
    [
        ("local[8]", None, "file:/tmp/w", "file:/tmp/w"),
        ("spark://host", "hdfs:///c/", "file:/tmp/w", "hdfs:///c"),
        ("spark://host", None, "hdfs:///w", "hdfs:///w"),
        ("spark://host", None, "file:/tmp/w", None),
        ("local-cluster[2,1,1024]", None, "/tmp/w", None),
    ],
)
def test_no_folder_of_one_machine_on_a_cluster(master, named, warehouse, folder):
    class Session:
        conf = {"spark.sql.warehouse.dir": warehouse} | ({"spark.checkpoint.dir": named} if named else {})

        class sparkContext:
            pass

    session = Session()
    session.sparkContext.master = master
    if folder:
        assert shared_folder(session) == folder
    else:
        with pytest.raises(ValueError, match="share"):
            shared_folder(session)
