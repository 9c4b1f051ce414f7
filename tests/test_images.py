"""Images that are decoded, shrunk and encoded, by value."""

import struct
import zlib
from pathlib import Path

import numpy as np

from vitrina.cli import main
from vitrina.functions.images import PixelEncoder, shrink
from vitrina.operators.backfill import encode_images, merge_embeddings, pending_rows
from vitrina.sources.readers import decoded_images
from vitrina.sources.writers import object_sink


def png(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def plain_shrink(image, side):
    """Cell by cell; a cell without a pixel takes the one it begins at."""
    height, width, _ = image.shape
    out = np.zeros((side, side, 3), np.uint8)
    for i in range(side):
        for j in range(side):
            top, left = i * height // side, j * width // side
            bottom, right = max((i + 1) * height // side, top + 1), max((j + 1) * width // side, left + 1)
            cell = image[top:bottom, left:right].reshape(-1, 3).astype(float)
            out[i, j] = np.floor(cell.mean(axis=0) + 0.5)
    return out


def folder_of_images(path):
    rng = np.random.default_rng(7)
    pictures = {
        "wide.png": rng.integers(0, 256, (5, 11, 3), np.uint8), "tiny.png": rng.integers(0, 256, (1, 2, 3), np.uint8),
        "deep/tall.png": rng.integers(0, 256, (300, 40, 3), np.uint8), "black.png": np.zeros((4, 4, 3), np.uint8),
    }
    (path / "deep").mkdir(parents=True)
    for name, pixels in pictures.items():
        (path / name).write_bytes(png(pixels))
    grey = rng.integers(0, 256, (6, 6, 1), np.uint8)
    clear = rng.integers(0, 256, (6, 6, 4), np.uint8)
    (path / "grey.png").write_bytes(png(grey))
    (path / "clear.png").write_bytes(png(clear))
    pictures["grey.png"], pictures["clear.png"] = np.repeat(grey, 3, axis=2), clear[:, :, :3]
    whole = png(pictures["deep/tall.png"])
    broken = {"cut.png": whole[:len(whole) // 2], "empty.png": b"", "text.png": b"no image", "head.png": whole[:20]}
    for name, content in broken.items():
        (path / name).write_bytes(content)
    return pictures, broken


def test_shrink_is_the_mean_of_cells():
    rng = np.random.default_rng(1)
    for height, width, side in [(1, 1, 4), (3, 7, 4), (8, 8, 4), (9, 5, 2), (100, 33, 7)]:
        image = rng.integers(0, 256, (height, width, 3), np.uint8)
        assert (shrink(image, side) == plain_shrink(image, side)).all()


def test_decoded_images(spark, tmp_path):
    pictures, broken = folder_of_images(tmp_path / "img")
    base = str(tmp_path / "img").strip("/")
    found = {r.path.removeprefix(base + "/"): r for r in decoded_images(spark, str(tmp_path / "img"), 3).collect()}
    assert set(found) == set(pictures) | set(broken) - {"empty.png"}
    for name, pixels in pictures.items():
        assert found[name].pixels == plain_shrink(pixels, 3).tobytes(), name
    assert all(found[name].pixels is None and found[name].length == len(content) for name, content in broken.items() if content)
    assert decoded_images(spark, str(tmp_path / "img"), 3, "wide*").count() == 1


def products(spark, base):
    names = ["wide.png", "wide.png", "black.png", "cut.png", "absent.png", None]
    rows = [(i, f"s3://{base}/{n}" if n else None, n, None, None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "id long, s3_url string, s3_path string, v array<float>, product_name string")


def test_vectors_by_value(spark, tmp_path):
    pictures, _ = folder_of_images(tmp_path / "img")
    rows = products(spark, str(tmp_path / "img").strip("/"))
    encoder = PixelEncoder(3)
    new = encode_images(rows, "v", encoder, decoded_images(spark, str(tmp_path / "img"), 3), "shelf")
    filled = {r.id: r.v for r in merge_embeddings(rows, new, "v").collect()}
    expected = plain_shrink(pictures["wide.png"], 3).reshape(-1).astype(float)
    expected /= np.linalg.norm(expected)
    assert np.abs(np.array(filled[0]) - expected).max() < 1e-6 and filled[0] == filled[1]
    assert filled[2] == [0.0] * encoder.dim
    assert filled[3] is None and filled[4] is None and filled[5] is None
    # What could not be decoded is asked for again.
    assert {r.id for r in pending_rows(merge_embeddings(rows, new, "v"), "v", need_image=True).collect()} == {3, 4}


def test_backfill_command(spark, tmp_path):
    folder_of_images(tmp_path / "img")
    products(spark, str(tmp_path / "img").strip("/")).drop("v").write.parquet(str(tmp_path / "products"))
    out = main([
        "backfill", "--mode", "image", "--products", str(tmp_path / "products"), "--images", str(tmp_path / "img"),
        "--column", "image_vector", "--output", str(tmp_path / "out"), "--bucket", "shelf",
        "--encoder", "vitrina.functions.images:PixelEncoder",
    ], spark)
    sizes = {r.id: r.image_vector and len(r.image_vector) for r in spark.read.parquet(out).collect()}
    assert sizes == {0: 192, 1: 192, 2: 192, 3: None, 4: None, 5: None}


def test_folder_without_images(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert decoded_images(spark, str(tmp_path / "none"), 3).collect() == []


def test_object_sink(spark, tmp_path):
    rows = [("a/1.bin", b"one"), ("a/2.bin", b"two"), ("b/1.bin", None), ("a/1.bin", b"one more"), (None, b"lost")]
    folder = object_sink(spark.createDataFrame(rows, "path string, content binary"), f"file://{tmp_path}/objects")
    assert folder.endswith("/objects")
    found = {str(p.relative_to(tmp_path / "objects")): p.read_bytes() for p in (tmp_path / "objects").rglob("*") if p.is_file()}
    assert found == {"a/1.bin": b"one", "a/2.bin": b"two", "b/1.bin": b""}
    assert object_sink(spark.createDataFrame(rows[:0], "path string, content binary"), f"{tmp_path}/nothing")


def test_images_are_listed_once_and_share_tasks(spark, tmp_path):
    pictures, broken = folder_of_images(tmp_path / "img")
    base = str(tmp_path / "img").strip("/")
    rows = decoded_images(spark, str(tmp_path / "img"), 3, undecoded=False)
    found = {r.path.removeprefix(base + "/"): r for r in rows.collect()}
    assert set(found) == set(pictures) and {"path", "length", "pixels"} == set(rows.columns)
    for name, pixels in pictures.items():
        assert found[name].pixels == plain_shrink(pixels, 3).tobytes() and found[name].length == (tmp_path / "img" / name).stat().st_size
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "Join" not in plan and "Coalesce" in plan


def test_few_folders_for_the_images_of_a_table(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    from checks.queries import image_files

    folder = image_files(spark, sf_dir).removeprefix("file://")
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    assert {p.stem for p in Path(folder).rglob("*.bmp")} == {str(i) for i in ids}
    assert {p.name for p in Path(folder).iterdir()} == {str(i // 1000) for i in ids}
