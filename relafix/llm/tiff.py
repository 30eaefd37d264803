"""TIFF columns: one row per page of a binary column.

``read_pages`` walks the image directories of each file, decodes PackBits, LZW
or deflate strips and tiles, undoes the horizontal predictor and emits the
samples of each page, row by row.  ``encode`` writes such files.  Samples have 8, 16
or 32 bits; pages of 1, 2 or 4 bits a sample and those with the floating-point
predictor are not decoded: their row has an ``error`` and null samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relafix.llm.shingles import small_batches

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_INTS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of 2 to 128 equal bytes as (count, byte), the rest as literals."""
    out, at, n = bytearray(), 0, len(data)
    literal = 0
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run >= 3 or (run == 2 and literal == at):
            while literal < at:
                piece = data[literal : min(at, literal + 128)]
                out += bytes([len(piece) - 1]) + piece
                literal += len(piece)
            out += bytes([257 - run, data[at]])
            literal = at + run
        at += run
    while literal < n:
        piece = data[literal : literal + 128]
        out += bytes([len(piece) - 1]) + piece
        literal += len(piece)
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_compress(data: bytes) -> bytes:
    """LZW as TIFF has it: most significant bit first, 9 to 12 bits, widths change one code early."""
    acc, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    fresh = {bytes([i]): i for i in range(256)}
    table, following, width = dict(fresh), 258, 9
    put(256, width)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = following
        following += 1
        if following > (1 << width) - 1:
            width += 1
        if following == 4094:
            put(256, min(width, 12))
            table, following, width = dict(fresh), 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_expand(data: bytes, size: int) -> bytes:
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last, out = list(base), 9, b"", bytearray()
    acc, bits = 0, 0
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code == 257:
            break
        if not last:
            last = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(last + entry[:1])
            last = entry
        out += last
        if len(out) >= size:
            break
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


_CODERS = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_compress, DEFLATE: lambda d: zlib.compress(d, 1), OLD_DEFLATE: lambda d: zlib.compress(d, 1)}


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data
    if how == PACKBITS:
        return unpack_bits(data, size)
    if how == LZW:
        return lzw_expand(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {how} is not supported")


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int | None = None, rows_per_strip: int = 1 << 14, order: str = "<") -> bytes:
    """A TIFF file of grey pages (2-D uint8 or uint16 arrays), in strips or square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), page.dtype)
            padded[:height, :width] = page
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, lengths = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = _CODERS[compression](np.ascontiguousarray(block).astype(block.dtype.newbyteorder(order)).tobytes())
            offsets.append(len(out))
            lengths.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [page.dtype.itemsize * 8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, lengths)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, lengths)]
        entries = bytearray()
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{_INTS[kind]}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """The tags of each image directory; a chain that comes back on itself ends there."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags = {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            place = at + 10 + 12 * i
            if _SIZES.get(kind, 1) * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if kind in _INTS:
                tags[tag] = list(struct.unpack_from(f"{order}{count}{_INTS[kind]}", data, place))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _samples(data: bytes, order: str, tags: dict[int, list[int]]) -> np.ndarray:
    """Rows x columns x samples of one page."""
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    bits, per = tags.get(BITS, [1]), tags.get(SAMPLES, [1])[0]
    if any(b != bits[0] for b in bits) or bits[0] not in (8, 16, 32):
        raise ValueError(f"{bits} bits a sample are not supported")
    kind = np.dtype(f"u{bits[0] // 8}").newbyteorder(order)
    how, predictor = tags.get(COMPRESSION, [1])[0], tags.get(PREDICTOR, [1])[0]
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not supported")
    planes = per if tags.get(PLANAR, [1])[0] == 2 else 1
    inner = per // planes
    tiled = TILE_OFFSETS in tags
    offsets, lengths = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    block_w, block_h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(tags.get(ROWS_PER_STRIP, [height])[0], height))
    across, down = -(-width // block_w), -(-height // block_h)
    out = np.zeros((height, width, per), kind)
    for k in range(planes * down * across):
        plane, y, x = k // (down * across), k // across % down * block_h, k % across * block_w
        rows = block_h if tiled else min(block_h, height - y)
        size = rows * block_w * inner * kind.itemsize
        raw = _expand(data[offsets[k] : offsets[k] + lengths[k]], how, size)
        if len(raw) < size:
            raise ValueError("a strip or tile is short")
        block = np.frombuffer(raw, kind, rows * block_w * inner).reshape(rows, block_w, inner)
        if predictor == 2:
            block = np.cumsum(block.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
        rows, columns = min(rows, height - y), min(block_w, width - x)
        out[y : y + rows, x : x + columns, plane * inner : (plane + 1) * inner] = block[:rows, :columns]
    return out


def pages_of(data: bytes | None) -> Iterator[dict]:
    """One dict per page; a page or file that cannot be read has its reason in ``error``."""
    none = {"page": None, "width": None, "height": None, "samples_per_pixel": None, "compression": None, "histogram": None, "samples": None}
    if not data:
        yield none | {"error": "no media"}
        return
    number = -1
    try:
        for number, (order, tags) in enumerate(_directories(data)):
            head = none | {"page": number, "width": tags.get(WIDTH, [None])[0], "height": tags.get(HEIGHT, [None])[0], "samples_per_pixel": tags.get(SAMPLES, [1])[0], "compression": tags.get(COMPRESSION, [1])[0], "error": None}
            try:
                values = _samples(data, order, tags)
                shift = values.dtype.itemsize * 8 - 4
                yield head | {"histogram": np.bincount((values.ravel() >> shift).astype(np.intp), minlength=16).tolist(), "samples": values.tobytes()}
            except (KeyError, IndexError, ValueError, TypeError, zlib.error) as e:
                yield head | {"error": f"{type(e).__name__}: {e}"}
    except (struct.error, ValueError) as e:
        yield none | {"page": number + 1, "error": f"{type(e).__name__}: {e}"}
    else:
        if number < 0:
            yield none | {"error": "no pages"}


_PAGE = "page int, width int, height int, samples_per_pixel int, compression int, histogram array<long>, samples binary, error string"


def read_pages(files: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each file: the columns of ``keep``, then
    ``page, width, height, samples_per_pixel, compression, histogram, samples, error``.

    ``samples`` are the decoded samples, row by row, in the file's byte order;
    ``histogram`` counts them in 16 equal classes.  A null or empty file and a
    file without pages give one row with a null page and an ``error``; a damaged
    page gives its row with an ``error`` and null samples.  Repeated rows give
    repeated pages.  Columns of ``keep`` must not carry the names above; the
    other columns of ``files`` are not looked at.
    """
    fields = [*files.select(*keep).schema.fields, *T.StructType.fromDDL(_PAGE).fields]
    names = [f.name for f in T.StructType.fromDDL(_PAGE).fields]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, origin = [], []
            for i, data in enumerate(batch["__media"]):
                for page in pages_of(bytes(data) if data is not None else None):
                    found.append(page)
                    origin.append(i)
            out = batch.drop(columns="__media").iloc[origin].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(found, columns=names).astype({n: "Int32" for n in names[:5]})], axis=1)

    packed = files.select(*keep, F.col(media_col).alias("__media"))
    return packed.mapInPandas(decode, T.StructType(fields))


def store_payload(payload: bytes) -> bytes:
    """A payload (a positive multiple of 64 bytes) as a grey 8-bit page, 64 samples wide."""
    return encode([np.frombuffer(payload, np.uint8).reshape(-1, 64)])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", store=store_payload) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, padded to a multiple of 64, as a file.

    A null text counts as empty; an empty text is one row of 64 zeros.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [bytes(b) for b in batch["body"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(b) for b in texts], "media": [store(b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")) for b in texts]})

    small_batches(docs.sparkSession)
    packed = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"))
    return packed.mapInPandas(pack, T.StructType([T.StructField("doc_id", packed.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads the file back and digests what was read; one row per document."""
    # ids travel as text: a batch with a null would turn integers to floats
    kind = docs.schema[id_col].dataType
    stored = store_texts(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))).withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    pages = read_pages(stored, "media", keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    feature = F.concat_ws(":", F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")), F.array_join(F.col("histogram").cast("array<string>"), ","))
    return pages.select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )
