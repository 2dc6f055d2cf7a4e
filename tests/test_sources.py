import io
import struct

import numpy as np
import pytest

from framelake.sources import formats, frames_io, pages


@pytest.fixture
def stack():
    return np.random.default_rng(5).integers(0, 60000, (6, 5, 7, 2)).astype(np.uint16)


@pytest.mark.parametrize(("fmt", "ending"), [("TIFF", "tif"), ("NPY", "npy"), ("MAT", "mat")])
def test_round_trip(spark, tmp_path, stack, fmt, ending):
    done = frames_io.write_frames(frames_io.from_array(spark, stack, "rec"), f"file://{tmp_path}/{fmt}", fmt, "uint16")
    assert done[0]["frames"] == 6
    back = frames_io.to_array(frames_io.read_frames(spark, f"{tmp_path}/{fmt}/rec.{ending}"))
    assert back.dtype == np.uint16 and (back == stack).all()


def test_interleaved_pages_and_channel_files(spark, tmp_path, stack):
    frames = frames_io.from_array(spark, stack, "rec")
    frames_io.write_frames(frames, f"file://{tmp_path}/s", "SUITE2P_TIFF", "uint16")
    back = frames_io.to_array(frames_io.read_frames(spark, f"{tmp_path}/s/rec.tif", channels=2))
    assert (back == stack).all()
    frames_io.write_frames(frames, f"file://{tmp_path}/m", "MULTIFILE_TIFF", "uint16")
    both = frames_io.read_frames(spark, [f"{tmp_path}/m/rec_ch1.tif", f"{tmp_path}/m/rec_ch2.tif"])
    assert (frames_io.to_array(both) == stack).all()


def test_other_sinks(spark, stack):
    frames = frames_io.from_array(spark, stack)
    assert (frames_io.write_frames(frames, None, "ARRAY") == stack).all()
    assert frames_io.write_frames(frames, None, "NULL")[0]["n_frames"] == 6
    with pytest.raises(NotImplementedError):
        frames_io.write_frames(frames, None, "BEGONIA")
    with pytest.raises(ValueError):
        frames_io.write_frames(frames, None, "XYZ")
    with pytest.raises(ValueError):
        frames_io.read_frames(spark, "a.xyz")


def test_shapes_and_datasets():
    assert frames_io.stacked(np.zeros((4, 5, 3))).shape == (1, 4, 5, 3)
    assert frames_io.stacked(np.zeros((4, 5, 6))).shape == (4, 5, 6, 1)
    shapes = {"g/ch10": (3, 4, 4), "g/ch2": (3, 4, 4), "other": (9, 9, 9)}
    assert formats.pick_dataset(shapes) == ["g/ch2", "g/ch10"]
    assert formats.pick_dataset({"mov": (1, 1, 1), "big": (9, 9, 9)}) == ["mov"]
    assert formats.pick_dataset({"a": (1, 1, 1), "big": (9, 9, 9)}) == ["big"]


def test_datasets_by_channel_number_anywhere_in_the_name():
    raw = {f"/roi/Chan {k} raw": (5, 4, 4) for k in (10, 2)}
    assert formats.pick_dataset({**raw, "ch1": (9, 9, 9)}) == ["/roi/Chan 2 raw", "/roi/Chan 10 raw"]
    assert formats.pick_dataset({"x_ch1": (5, 4, 4), "x_ch2": (6, 4, 4), "/Data": (2, 2, 2), "y": (9, 9, 9)}) == ["/Data"]
    assert formats.pick_dataset({"a": (2, 3, 4), "b": (4, 3, 2), "c": (2, 3, 4), "flat": (900, 900)}) == ["a", "c"]
    with pytest.raises(ValueError):
        formats.pick_dataset({"flat": (900, 900)})


def test_binned_on_read(spark, stack):
    frames = frames_io.read_frames(spark, stack[:5], bin_size=2)
    back = frames_io.to_array(frames)
    np.testing.assert_allclose(back[2], stack[4])
    np.testing.assert_allclose(back[0], stack[:2].astype(float).mean(0))


@pytest.mark.parametrize(("fmt", "kind", "ending"), [("TIFF", "tiff", "tif"), ("NPY", "npy", "npy")])
def test_a_filter_reads_only_its_pages(spark, tmp_path, stack, fmt, kind, ending):
    frames_io.write_frames(frames_io.from_array(spark, stack, "rec"), f"file://{tmp_path}", fmt, "uint16", deflate=True)
    frames = pages.read_pages(spark, [f"file://{tmp_path}/rec.{ending}"], kind, run_bytes=2 * stack[0].size * 8)
    assert frames.rdd.getNumPartitions() == 3
    late = frames.where("t >= 4")
    assert late.rdd.getNumPartitions() == 1 and (frames_io.to_array(late) == stack[4:]).all()
    assert (frames_io.to_array(frames.where("t in (1, 5)")) == stack[[1, 5]]).all()
    assert frames.where("rec_id = 'other'").count() == 0 and frames.where("t > 99").count() == 0
    seen = pages.PageReader([f"file://{tmp_path}/rec.{ending}"], kind, 1 << 20)
    list(seen.pushFilters([pages.EqualTo(("t",), 3)]))
    assert [b.num_rows for run in seen.partitions() for b in seen.read(run)] == [1]


def test_a_file_over_two_gigabytes_is_read_in_ranges(spark, tmp_path):
    path = tmp_path / "long.npy"
    with open(path, "wb") as out:  # a sparse file
        np.lib.format.write_array_header_2_0(out, {"descr": "|u1", "fortran_order": False, "shape": (2500, 1024, 1024)})
        out.seek(2400 << 20, 1)
        out.write(b"\7" * (1 << 20))
        out.truncate(out.tell() + (99 << 20))
    row = frames_io.read_frames(spark, str(path)).where("t = 2400").selectExpr("rec_id", "h", "w", "aggregate(data, 0D, (a, x) -> a + x) AS total").collect()
    assert [tuple(r) for r in row] == [("long.npy", 1024, 1024, 7.0 * (1 << 20))]


def test_arrays_in_column_order_and_bundles_are_read_whole(spark, tmp_path, stack):
    np.save(tmp_path / "f.npy", np.asfortranarray(stack))
    np.savez(tmp_path / "b.npz", mov=stack)
    for name in ("f.npy", "b.npz"):
        assert (frames_io.to_array(frames_io.read_frames(spark, f"{tmp_path}/{name}")) == stack).all()


def tiff(order, tags, body, at=8):
    """A file of one directory after ``body``; tags as (number, type, values)."""
    start, entries, lists = at + len(body), b"", b""
    extra = start + 2 + 12 * len(tags) + 4
    for number, kind, values in tags:
        packed = values if kind == 2 else struct.pack(f"{order}{len(values)}{'?BsHI'[kind]}", *values)
        if len(packed) > 4:
            field, lists = struct.pack(order + "I", extra + len(lists)), lists + packed
        else:
            field = packed.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", number, kind, len(values)) + field
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", start) + body + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + lists


def lzw(data):
    """Plain LZW: a code for the longest known start, which with its next byte becomes a new entry."""
    table, codes, widths, word = {bytes([k]): k for k in range(256)}, [256], [9], b""
    size, width = 258, 9
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        codes.append(table[word])
        widths.append(width)
        table[word + bytes([byte])] = size
        size += 1
        width = 9 + (size > 511) + (size > 1023) + (size > 2047)
        if size == 4094:
            codes.append(256)
            widths.append(width)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = bytes([byte])
    codes += [table[word], 257]
    widths += [width, 9 + (size + 1 > 511) + (size + 1 > 1023) + (size + 1 > 2047)]
    bits = "".join(f"{c:0{w}b}" for c, w in zip(codes, widths, strict=True))
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("n", [1, 300, 3000, 40000])
def test_lzw(n):
    r = np.random.default_rng(n)
    for data in (r.integers(0, 256, n).astype(np.uint8).tobytes(), r.integers(0, 3, n).astype(np.uint8).tobytes(), b"a" * n):
        assert formats._lzw(lzw(data)) == data


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiles_strips_and_predictors(order):
    page = np.random.default_rng(1).integers(0, 60000, (37, 50, 2)).astype(np.uint16)
    padded = np.pad(page, ((0, 11), (0, 14), (0, 0)))
    shape = [(256, 3, (50,)), (257, 3, (37,)), (258, 3, (16, 16))]

    def blocks(parts, pack):
        packed = [pack(np.diff(p.astype(f"{order}u2"), axis=1, prepend=0).astype(f"{order}u2").tobytes()) for p in parts]
        ends = np.cumsum([8] + [len(p) for p in packed])
        return packed, tuple(ends[:-1].tolist()), tuple(len(p) for p in packed)

    packed, at, sizes = blocks([padded[y : y + 16, x : x + 16] for y in range(0, 48, 16) for x in range(0, 64, 16)], lzw)
    tiles = [*shape, (259, 3, (5,)), (277, 3, (2,)), (317, 3, (2,)), (322, 3, (16,)), (323, 3, (16,)), (324, 4, at), (325, 4, sizes), (339, 3, (1, 1))]
    assert (formats.read_tiff(tiff(order, tiles, b"".join(packed)))[0] == page).all()
    packed, at, sizes = blocks([page[y : y + 10] for y in range(0, 37, 10)], lambda b: b"".join(bytes([len(b[k : k + 100]) - 1]) + b[k : k + 100] for k in range(0, len(b), 100)))
    strips = [*shape, (259, 3, (32773,)), (273, 4, at), (277, 3, (2,)), (278, 3, (10,)), (279, 4, sizes), (317, 3, (2,)), (339, 3, (1, 1))]
    assert (formats.read_tiff(tiff(order, strips, b"".join(packed)))[0] == page).all()


def test_a_lone_directory_that_counts_more_images():
    images = np.arange(4 * 3 * 5, dtype="<u2").reshape(4, 3, 5)
    tags = [(256, 3, (5,)), (257, 3, (3,)), (258, 3, (16,)), (270, 2, b"ImageJ=1.53\nimages=4\nslices=4\n\0"), (273, 4, (8,)), (279, 4, (30,))]
    data = tiff("<", tags, images.tobytes())
    assert (formats.read_tiff(data)[..., 0] == images).all()
    assert (formats.TiffFile(io.BytesIO(data)).page((8 + images.nbytes, 2))[..., 0] == images[2]).all()
