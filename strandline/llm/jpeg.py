"""Baseline JPEG as a media column: coding, marker parsing, Huffman decoding, DC-only luminance thumbnails."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, byte_texts, texts_of

# Fixed values of the JPEG standard (ITU-T T.81): markers, and the typical luminance DC table of its annex K.
SOI, EOI, SOS, DQT, DHT, DRI, SOF0, APP0, COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC0, 0xE0, 0xFE
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
#: The coder's AC table has one code, a single 0 bit for "end of block".
AC_COUNTS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)

UNIT = 576  # bytes: 24 rows of 24 samples
WIDTH = 24  # samples in a row of a thumbnail, and blocks between restart markers
MOST_ROWS = 8184  # a frame's height is at most 65,535 pixels of 8 a block


class Huffman:
    """A table as 65,536 entries: code length << 8 | symbol, by the next 16 bits; where no code fits, a length that leads past any scan."""

    def __init__(self, counts, symbols):
        if len(counts) < 16 or len(symbols) < sum(counts) or sum(n << (16 - k) for k, n in enumerate(counts, 1)) > 1 << 16:
            raise ValueError("a bad Huffman table")
        self.look = np.full(1 << 16, 1 << 30, dtype=np.int32)
        self.codes = np.zeros(256, dtype=np.int64)
        self.lengths = np.zeros(256, dtype=np.int64)
        code, k = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                symbol = symbols[k]
                self.codes[symbol], self.lengths[symbol] = code, length
                first = code << (16 - length)
                self.look[first : first + (1 << (16 - length))] = length << 8 | symbol
                code, k = code + 1, k + 1
            code <<= 1


_DC = Huffman(DC_COUNTS, DC_SYMBOLS)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    """All before the scan's data: one component of WIDTH x rows blocks, DC step 8, so that a block's mean is its DC value + 128."""
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * WIDTH).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return (
        bytes([0xFF, SOI])
        + _segment(APP0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(DQT, bytes([0] + [8] * 64))
        + _segment(SOF0, frame)
        + _segment(DHT, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]))
        + _segment(DHT, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS]))
        + _segment(DRI, WIDTH.to_bytes(2, "big"))
        + _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _by_diff() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference + 255: the bits of a whole DC-only block (size code, value, end of block) and their number."""
    diff = np.arange(-255, 256)
    size = np.array([int(abs(d)).bit_length() for d in diff])
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return (_DC.codes[size] << size | value) << 1, _DC.lengths[size] + size + 1


_BITS, _NBITS = _by_diff()


def encode_samples(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan data of many restart intervals: WIDTH samples each, in a row; a block's mean is its sample.

    Gives the bytes, stuffed, without markers, and each interval's end in them."""
    rows = samples.reshape(-1, WIDTH).astype(np.int16) - 128
    index = rows.copy()
    index[:, 1:] -= rows[:, :-1]
    index += 255
    n = _NBITS[index]
    ends = np.cumsum(n, axis=1)
    length = (ends[:, -1] + 7) // 8
    base = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(int(base[-1]) + 8, dtype=np.uint8)
    at = (base[:-1, None] * 8 + ends - n).ravel()
    width, word = n.ravel(), _BITS[index].ravel()
    # each code has at most 16 + 1 bits, so it lies in 4 bytes; codes don't overlap, so their bits are added up
    word = word << (32 - (at & 7) - width)
    first = at >> 3
    for k in range(4):
        part = (word >> (24 - 8 * k)) & 255
        out[: len(out)] += np.bincount(first + k, weights=part, minlength=len(out))[: len(out)].astype(np.uint8)
    last, pad = base[1:] - 1, (-ends[:, -1]) % 8
    out[last] |= ((1 << pad) - 1).astype(np.uint8)  # the standard fills up with 1 bits
    out = out[:-8]
    full = out == 0xFF
    stuffed = np.repeat(out, 1 + full)
    shift = np.cumsum(full)
    stuffed[(np.arange(len(out)) + shift)[full]] = 0
    return stuffed, base[1:] + shift[base[1:] - 1]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One media value per payload (a positive multiple of UNIT bytes): a JPEG, or several one after another where a frame would be too high."""
    data, ends = encode_samples(np.frombuffer(b"".join(payloads), dtype=np.uint8))
    data, begins, ends, row, out = data.tobytes(), [0, *ends[:-1].tolist()], ends.tolist(), 0, []
    marks = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
    for p in payloads:
        left, parts = len(p) // WIDTH, []
        while left:
            rows = min(left, MOST_ROWS)
            parts.append(_header(rows))
            for k in range(rows):
                if k:
                    parts.append(marks[(k - 1) & 7])
                parts.append(data[begins[row] : ends[row]])
                row += 1
            parts.append(bytes([0xFF, EOI]))
            left -= rows
        out.append(b"".join(parts))
    return out


class Frame:
    """What the markers of one image say, and where its scan's data are."""

    def __init__(self):
        self.quant, self.dc, self.ac, self.parts, self.interval = {}, {}, {}, [], 0
        self.height = self.width = self.hmax = self.vmax = 0
        self.scan = None


_tables: dict[bytes, list] = {}


def _huffman_tables(body: bytes) -> list:
    """(class, id, table) of a DHT segment; a table seen before isn't built again."""
    if body not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        at, found = 0, []
        while at < len(body):
            counts = tuple(body[at + 1 : at + 17])
            symbols = tuple(body[at + 17 : at + 17 + sum(counts)])
            found.append((body[at] >> 4, body[at] & 15, Huffman(counts, symbols)))
            at += 17 + sum(counts)
        _tables[body] = found
    return _tables[body]


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")  # that ends a scan's data


def parse(media: bytes) -> list[Frame]:
    """The frames of a media value, each with the scan that holds its first component, the luminance. ValueError for what isn't whole baseline JPEGs."""
    frames, at = [], 0
    while at < len(media) or not frames:
        if media[at : at + 2] != bytes([0xFF, SOI]):
            raise ValueError("no start of image")
        at, f = at + 2, Frame()
        while True:
            while media[at : at + 2] == b"\xff\xff":  # fill bytes
                at += 1
            if at + 2 > len(media) or media[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = media[at + 1]
            if marker == EOI:
                at += 2
                break
            n = int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + n]
            if n < 2 or len(body) != n - 2:
                raise ValueError("a segment is cut off")
            at += 2 + n
            if marker == SOS:
                end = _MARKER.search(media, at)
                if not end:
                    raise ValueError("no end of image")
                if f.scan is None:
                    _scan(f, body, at, end.start())
                at = end.start()
            elif f.scan is None:  # what follows the luminance is for other scans
                _tables_of(f, marker, body)
        if f.scan is None:
            raise ValueError("no luminance scan")
        frames.append(f)
    return frames


def _tables_of(f: Frame, marker: int, body: bytes) -> None:
    if marker == DQT:
        k = 0
        while k < len(body):
            wide = body[k] >> 4
            f.quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")  # only the DC step is used
            k += 1 + 64 * (1 + wide)
    elif marker == DHT:
        for kind, number, table in _huffman_tables(body):
            (f.ac if kind else f.dc)[number] = table
    elif marker == DRI:
        f.interval = int.from_bytes(body, "big")
    elif marker == SOF0:
        if len(body) < 6 or len(body) != 6 + 3 * body[5] or not body[5]:
            raise ValueError("a bad frame header")
        if body[0] != 8:
            raise ValueError("not 8-bit samples")
        f.height, f.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        f.parts = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k], 0, 0] for k in range(body[5])]
        f.hmax, f.vmax = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
        if not f.height or not f.width or not all(p[1] and p[2] for p in f.parts):
            raise ValueError("a bad frame header")
    elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
        raise ValueError("not baseline")


def _scan(f: Frame, body: bytes, begin: int, end: int) -> None:
    """Takes the scan for the frame's if it holds the first component. One with that alone is in that component's own blocks, not in units of all components."""
    if not f.parts or not body or len(body) != 4 + 2 * body[0]:
        raise ValueError("a bad scan header")
    tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    if f.parts[0][0] not in tables:
        return
    parts = [[*p[:4], tables[p[0]] >> 4, tables[p[0]] & 15] for p in f.parts if p[0] in tables]
    if len(parts) != body[0] or any(p[4] not in f.dc or p[5] not in f.ac for p in parts) or parts[0][3] not in f.quant:
        raise ValueError("a table is missing")
    if len(parts) == 1:
        f.width, f.height = -(-f.width * parts[0][1] // f.hmax), -(-f.height * parts[0][2] // f.vmax)
        f.hmax = f.vmax = 1
    units = -(-f.width // (8 * f.hmax)) * -(-f.height // (8 * f.vmax))
    if units * (1 if len(parts) == 1 else sum(p[1] * p[2] for p in parts)) > 4 * (end - begin):  # a block takes two bits at least
        raise ValueError("a scan ends too early")
    f.parts, f.scan = parts, (begin, end)


def _layout(f: Frame) -> tuple:
    """What must agree for frames to be decoded together: the scan's components, tables and blocks of a unit."""
    single = len(f.parts) == 1
    return (f.hmax, f.vmax, *((1 if single else p[1], 1 if single else p[2], id(f.dc[p[4]]), id(f.ac[p[5]])) for p in f.parts))


def thumbnails(media: list[bytes | None]) -> list[list[np.ndarray] | str | None]:
    """For each media value, the luminance thumbnail of each of its frames: one 8-bit sample per 8 x 8 block. Null for a null, and what is
    wrong, as text, for what can't be decoded.

    The restart intervals of all frames of one layout are lanes of numpy arrays that are Huffman-decoded in step, so a frame without restart
    markers is one lane."""
    out: list = [None] * len(media)
    groups: dict[tuple, list] = {}
    for i, m in enumerate(media):
        try:
            frames = parse(m) if m is not None else []
        except ValueError as e:
            out[i] = str(e)
            continue
        if m is not None:
            out[i] = [None] * len(frames)
        for k, f in enumerate(frames):
            groups.setdefault(_layout(f), []).append((i, k, f))
    for members in groups.values():
        try:
            images = _decode(media, [(i, f) for i, _, f in members])
        except ValueError:  # one of them is bad: each on its own
            images = []
            for i, _, f in members:
                try:
                    images += _decode(media, [(i, f)])
                except ValueError as e:
                    images.append(str(e))
        for (i, k, _), image in zip(members, images, strict=True):
            if isinstance(image, str):
                out[i] = image
            elif not isinstance(out[i], str):
                out[i][k] = image
    return out


def _decode(media: list[bytes], members: list) -> list[np.ndarray]:
    first = members[0][1]
    single = len(first.parts) == 1
    sampling = [(1, 1)] if single else [(p[1], p[2]) for p in first.parts]
    hmax, vmax = first.hmax, first.vmax
    raw = np.frombuffer(b"".join(media[i][f.scan[0] : f.scan[1]] + b"\xff\xd9" for i, f in members), dtype=np.uint8)
    after = np.append(raw[1:], 0)
    mark = (raw == 0xFF) & (after != 0)
    ends = np.flatnonzero(mark)  # of intervals; the end of image closes a frame's last one
    keep = np.ones(len(raw), dtype=bool)
    keep[ends] = keep[ends + 1] = False
    keep[1:] &= ~((raw[:-1] == 0xFF) & (raw[1:] == 0))
    data = raw[keep]
    place = np.cumsum(keep)
    stops = place[ends]
    starts = np.concatenate([[0], stops[:-1]])
    units = []  # MCUs in each interval
    for _, f in members:
        total = -(-f.width // (8 * hmax)) * -(-f.height // (8 * vmax))
        step = f.interval or total
        units += [step] * (total // step) + [total % step] * bool(total % step)
    units = np.array(units, dtype=np.int64)
    if len(units) != len(starts):
        raise ValueError("restart markers are missing")
    padded = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint32)
    words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    base = np.concatenate([[0], np.cumsum(units)])
    luma = sampling[0][0] * sampling[0][1]
    values = np.zeros(int(base[-1]) * luma, dtype=np.int32)
    order = np.argsort(-units, kind="stable")
    lanes = 1 << 15
    for k in range(0, len(order), lanes):
        _lanes(order[k : k + lanes], starts, stops, units, base, words, values, first, sampling, luma)
    images, at = [], 0
    for _, f in members:
        across, down = -(-f.width // (8 * hmax)), -(-f.height // (8 * vmax))
        n, (h, v) = across * down, sampling[0]
        grid = values[at * luma : (at + n) * luma].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        at += n
        step = f.quant[f.parts[0][3]]
        mean = np.clip(np.floor_divide(grid * step + 4, 8) + 128, 0, 255).astype(np.uint8)
        images.append(mean[: -(-f.height * v // (8 * vmax)), : -(-f.width * h // (8 * hmax))])
    return images


def _lanes(lane, starts, stops, units, base, words, values, frame, sampling, luma) -> None:
    bit = starts[lane] * 8
    limit = stops[lane] * 8 + 7
    left, target = units[lane], base[lane] * luma
    pred = [np.zeros(len(lane), dtype=np.int64) for _ in frame.parts]
    most = len(words) - 1
    for unit in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -unit, side="left"))  # lanes are sorted by their number of units
        if live < len(bit):
            if (bit[live:] > limit[live:]).any():
                raise ValueError("a scan ends too early")
            bit, limit, left, target = bit[:live], limit[:live], left[:live], target[:live]
            pred = [p[:live] for p in pred]
        for c, (h, v) in enumerate(sampling):
            dc, ac = frame.dc[frame.parts[c][4]].look, frame.ac[frame.parts[c][5]].look
            for k in range(h * v):
                found = dc[words[np.minimum(bit >> 3, most)] >> (16 - (bit & 7)).astype(np.uint32) & 0xFFFF]
                size = found & 255
                bit = bit + (found >> 8)
                got = (words[np.minimum(bit >> 3, most)] >> (16 - (bit & 7)).astype(np.uint32) & 0xFFFF).astype(np.int64) >> (16 - size)
                bit += size
                pred[c] = pred[c] + np.where(got >> np.maximum(size - 1, 0) | (size == 0), got, got - (1 << size.astype(np.int64)) + 1)
                if c == 0:
                    values[target + k] = pred[0]
                bit = _skip_ac(bit, words, ac, most)
        target = target + luma
    if (bit > limit).any():
        raise ValueError("a scan ends too early")


def _skip_ac(bit: np.ndarray, words: np.ndarray, look: np.ndarray, most: int) -> np.ndarray:
    """Past the other 63 coefficients of a block, in each lane."""
    found = look[words[np.minimum(bit >> 3, most)] >> (16 - (bit & 7)).astype(np.uint32) & 0xFFFF]
    bit = bit + (found >> 8)
    open_ = np.flatnonzero(found & 255)
    at = np.zeros(len(bit), dtype=np.int64) if len(open_) else None
    while len(open_):
        symbol = found[open_] & 255
        bit[open_] += symbol & 15
        at[open_] += (symbol >> 4) + 1
        open_ = open_[at[open_] < 63]
        if not len(open_):
            break
        b = bit[open_]
        found[open_] = look[words[np.minimum(b >> 3, most)] >> (16 - (b & 7)).astype(np.uint32) & 0xFFFF]
        bit[open_] += found[open_] >> 8
        open_ = open_[(found[open_] & 255) != 0]
    return bit


def mean_hash(samples: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are brighter than their mean. A cell has one sample at least, so in a
    smaller thumbnail some share it."""
    h, w = samples.shape
    sums = np.add.reduceat(np.add.reduceat(samples.astype(np.int64), np.arange(8) * h // 8, axis=0), np.arange(8) * w // 8, axis=1)
    count = np.outer(*(np.maximum(1, np.diff(np.append(np.arange(8) * n // 8, n))) for n in (h, w)))
    means = sums / count
    return int.from_bytes(np.packbits((means > means.mean()).ravel()).tobytes(), "big")


def _store(batches):
    for batch in blocks(batches, 2 << 20):
        texts = byte_texts(batch)
        payloads = [t + b"\xff" * (max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t)) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode_payloads(payloads), pa.binary())], ["doc_id", "n_bytes", "media"]
        )


def _read(batches):
    for batch in blocks(batches, 4 << 20, "media"):
        images = thumbnails(batch.column(batch.schema.get_field_index("media")).to_pylist())
        whole, errors = [], []
        for found in images:
            error = found if isinstance(found, str) else None
            if isinstance(found, list) and len({i.shape[1] for i in found}) > 1:
                error = "frames of different widths"
            errors.append(error)
            whole.append(np.concatenate(found) if isinstance(found, list) and not error else None)
        known = lambda f: [None if i is None else f(i) for i in whole]
        columns = [
            pa.array(
                known(lambda i: i.shape[1] * 8), pa.int32()
            ), pa.array(known(lambda i: i.shape[0] * 8), pa.int32()), pa.array(known(lambda i: i.tobytes()), pa.binary()),
            pa.array(known(lambda i: f"{mean_hash(i):016x}"), pa.string()), pa.array(errors, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "width", "height", "thumbnail", "thumbnail_hash", "error"])


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes as the samples of a baseline JPEG's thumbnail.

    The bytes are followed by 255s up to a positive multiple of 576 and stored as the DC values of flat 8 x 8 blocks, 24 in
    a row, so a decoder that reconstructs the DC values alone gives them back without loss. A payload of more than
    8,184 rows is several frames, one after another. Null or empty text: 576 bytes of 255. Null or repeated ids:
    rows of their own. Empty table: no rows. Other columns are not read."""
    return texts_of(docs, doc_id, text).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Adds width, height (of all frames together, in pixels), thumbnail (samples, row by row), thumbnail_hash and error.

    `media` should hold baseline JPEGs: any sampling, tables and restart intervals, in one scan or several. Where a value is empty, cut off,
    not baseline or no JPEG, or its frames differ in width, error says so and the rest is null, and other rows aren't touched. A null value
    has nulls and no error."""
    types = {f.name: f.dataType.simpleString() for f in media.schema.fields}
    schema = ", ".join(f"`{n}` {t}" for n, t in types.items()) + ", width int, height int, thumbnail binary, thumbnail_hash string, error string"
    return media.mapInArrow(_read, schema)
