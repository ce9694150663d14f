"""Volume formats, by their public definitions: NIfTI-1 and NRRD, headers and voxels.

A header is a dict with size, spacing_mm, origin_mm and direction (three unit columns, row by row) in LPS world axes,
channels, dtype, and where the voxels are. Arrays are indexed [z, y, x] or [z, y, x, channel].
"""

from __future__ import annotations

import bz2
import gzip
import io
import struct
import zlib

import numpy as np

# Fixed values of NIfTI-1: data type codes; header and data offsets; three-byte colours.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
NIFTI_HEAD, NIFTI_DATA, NIFTI_RGB = 348, 352, 128
# Fixed values of NRRD: names of types.
NRRD_TYPES = {
    "i1": ("signed char", "int8", "int8_t"),
    "u1": ("uchar", "unsigned char", "uint8", "uint8_t"),
    "i2": ("short", "short int", "signed short", "int16", "int16_t"),
    "u2": ("ushort", "unsigned short", "uint16", "uint16_t"),
    "i4": ("int", "signed int", "int32", "int32_t"),
    "u4": ("uint", "unsigned int", "uint32", "uint32_t"),
    "i8": ("longlong", "long long", "int64", "int64_t"),
    "u8": ("ulonglong", "unsigned long long", "uint64", "uint64_t"),
    "f4": ("float",),
    "f8": ("double",),
}
#: World axes of spaces, against LPS.
NRRD_SPACES = {"left-posterior-superior": (1, 1, 1), "lps": (1, 1, 1), "right-anterior-superior": (-1, -1, 1), "ras": (-1, -1, 1), "left-anterior-superior": (1, -1, 1), "las": (1, -1, 1)}
#: Bytes of a file that are read for its header alone.
HEAD = 1 << 16


def inflated(content: bytes, most: int | None = None) -> bytes:
    """The content, unzipped if it is zipped; no more than `most` bytes of it, which may be cut off in the middle."""
    if content[:2] != b"\x1f\x8b":
        return content[:most]
    if most is None:
        return gzip.decompress(content)
    return zlib.decompressobj(31).decompress(content, most)


def _unit(columns: np.ndarray) -> tuple[list[float], np.ndarray]:
    """Lengths of the columns, and the columns at length 1; a column of zeros is its own axis."""
    size = np.sqrt((columns**2).sum(axis=0))
    return [float(s) for s in size], np.where(size > 0, columns / np.where(size > 0, size, 1), np.eye(3))


def _quaternion(b: float, c: float, d: float, flip: float) -> np.ndarray:
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b]])
    return r * np.array([1, 1, -1 if flip < 0 else 1])


def nifti_header(data: bytes) -> dict:
    order = next((o for o in "<>" if len(data) >= NIFTI_HEAD and struct.unpack_from(o + "i", data)[0] == NIFTI_HEAD), None)
    if order is None:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack_from(order + "8h", data, 40)
    code, pixdim = struct.unpack_from(order + "h", data, 70)[0], struct.unpack_from(order + "8f", data, 76)
    offset, slope, shift = struct.unpack_from(order + "3f", data, 108)
    size, extra = [max(1, n) if i < dim[0] else 1 for i, n in enumerate(dim[1:8])], 1
    if dim[0] < 3 or size[3] > 1 or any(n > 1 for n in size[5:]):
        raise ValueError(f"three dimensions are read, not {[n for n in size if n > 1]}")
    extra = size[4]
    qform, sform = struct.unpack_from(order + "2h", data, 252)
    if sform > 0:
        rows = np.array(struct.unpack_from(order + "12f", data, 280), dtype=np.float64).reshape(3, 4)
        spacing, direction = _unit(rows[:, :3])
        origin = rows[:, 3]
    elif qform > 0:
        b, c, d, *origin = struct.unpack_from(order + "6f", data, 256)
        spacing, direction, origin = [float(p) for p in pixdim[1:4]], _quaternion(b, c, d, pixdim[0]), np.array(origin, dtype=np.float64)
    else:
        spacing, direction, origin = [float(p) for p in pixdim[1:4]], np.diag([-1.0, -1.0, 1.0]), np.zeros(3)
    lps = np.array([-1.0, -1.0, 1.0])  # the format's world is RAS
    rgb = code == NIFTI_RGB
    if not rgb and code not in NIFTI_TYPES:
        raise ValueError(f"unknown data type {code}")
    return {
        "format": "nifti", "size": size[:3], "channels": 3 if rgb else extra, "interleaved": rgb, "spacing_mm": spacing, "origin_mm": (origin * lps + 0.0).tolist(),
        "direction": (direction * lps[:, None] + 0.0).ravel().tolist(), "dtype": "u1" if rgb else NIFTI_TYPES[code], "order": order, "offset": int(offset) or NIFTI_DATA,
        "slope": slope if slope and np.isfinite(slope) else 1.0, "shift": shift if slope and np.isfinite(shift) else 0.0,
    }


def _vectors(text: str) -> list[np.ndarray | None]:
    """`(1,0,0) none (0,1,0)` as vectors."""
    return [None if part.startswith("none") else np.array([float(x) for x in part.strip("()").split(",")]) for part in text.replace(" (", "|(").replace(" none", "|none").split("|")]


def nrrd_header(data: bytes) -> dict:
    if not data.startswith(b"NRRD"):
        raise ValueError("not an NRRD header")
    ends = [(data.find(mark), len(mark)) for mark in (b"\n\n", b"\r\n\r\n") if data.find(mark) >= 0]
    if not ends:
        raise ValueError("the header does not end")
    at, skip = min(ends)
    fields = {}
    for line in data[:at].decode("latin-1").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon and not line.startswith("#") and not value.startswith("="):
            fields[name.strip().lower()] = value.strip()
    if "data file" in fields or "datafile" in fields:
        raise ValueError("the voxels are in another file")
    sizes, dtype = [int(x) for x in fields["sizes"].split()], next(k for k, names in NRRD_TYPES.items() if fields["type"].lower() in names)
    vectors = _vectors(fields["space directions"]) if "space directions" in fields else None
    kinds = fields.get("kinds", "").split()
    lead = [i for i, v in enumerate(vectors) if v is None] if vectors else [i for i, k in enumerate(kinds) if k not in ("domain", "space")][: len(sizes) - 3]
    if len(sizes) - len(lead) != 3 or len(lead) > 1 or lead not in ([], [0], [3]):
        raise ValueError(f"three dimensions are read, not {sizes}")
    world = np.array(NRRD_SPACES.get(fields.get("space", "lps").lower(), (1, 1, 1)), dtype=np.float64)
    if vectors:
        spacing, direction = _unit(np.stack([v for v in vectors if v is not None], axis=1))
    else:
        given = [float(x) for i, x in enumerate(fields.get("spacings", "").split()) if i not in lead]
        spacing, direction = given or [1.0, 1.0, 1.0], np.eye(3)
    origin = _vectors(fields["space origin"])[0] if "space origin" in fields else np.zeros(3)
    return {
        "format": "nrrd", "size": [n for i, n in enumerate(sizes) if i not in lead], "channels": sizes[lead[0]] if lead else 1, "interleaved": lead == [0], "spacing_mm": spacing,
        "origin_mm": (origin * world + 0.0).tolist(), "direction": (direction * world[:, None] + 0.0).ravel().tolist(), "dtype": dtype, "order": ">" if fields.get("endian", "little").lower() == "big" else "<",
        "offset": at + skip, "encoding": fields.get("encoding", "raw").lower(), "slope": 1.0, "shift": 0.0,
    }


def header(data: bytes) -> dict:
    """Header from the first bytes of a file."""
    if data.startswith(b"NRRD"):
        return nrrd_header(data)
    return nifti_header(inflated(data, NIFTI_DATA))


def volume(content: bytes) -> tuple[dict, np.ndarray]:
    """Header and array of a whole file."""
    if content.startswith(b"NRRD"):
        h, body = nrrd_header(content), None
        body = content[h["offset"] :]
        if h["encoding"] in ("gz", "gzip"):
            body = gzip.decompress(body)
        elif h["encoding"] in ("bz2", "bzip2"):
            body = bz2.decompress(body)
        elif h["encoding"] in ("text", "txt", "ascii"):
            body = np.array(body.split(), dtype=np.float64).astype(h["order"] + h["dtype"]).tobytes()
        elif h["encoding"] != "raw":
            raise ValueError(f"unknown encoding {h['encoding']}")
    else:
        content = inflated(content)
        h = nifti_header(content)
        body = memoryview(content)[h["offset"] :]
    n, shape = int(np.prod(h["size"])) * h["channels"], h["size"][::-1]
    raw = np.frombuffer(body, h["order"] + h["dtype"], n)
    if h["channels"] == 1:
        out = raw.reshape(shape)
    elif h["interleaved"]:
        out = raw.reshape([*shape, h["channels"]])
    else:
        out = np.moveaxis(raw.reshape([h["channels"], *shape]), 0, -1)
    return h, out if h["slope"] == 1 and h["shift"] == 0 else out * h["slope"] + h["shift"]


def collapsed(array: np.ndarray) -> tuple[np.ndarray, str | None]:
    """One channel: the first if all are equal, else their mean in single precision; and which of these it was."""
    if array.ndim == 3:
        return array, None
    if (array == array[..., :1]).all():
        return array[..., 0], "identical_components_collapsed_to_first"
    return array.mean(axis=-1, dtype=np.float32), "nonidentical_rgb_components_averaged_to_greyscale"


def oriented(h: dict, array: np.ndarray) -> tuple[dict, np.ndarray]:
    """The same volume with its axes next to the world's: x to the left, y to the back, z up. Axes are swapped and
    reversed only, so voxels keep their values and their places."""
    direction = np.array(h["direction"], dtype=np.float64).reshape(3, 3)  # column i: where index axis i points
    left, axis_of = np.abs(direction), [0, 0, 0]
    for _ in range(3):  # the clearest pair first
        world, axis = np.unravel_index(np.argmax(left), (3, 3))
        axis_of[world] = int(axis)
        left[world, :] = left[:, axis] = -1
    flips = [direction[w, axis_of[w]] < 0 for w in range(3)]
    size, spacing = ([h[k][a] for a in axis_of] for k in ("size", "spacing_mm"))
    columns = direction[:, axis_of]
    origin = np.array(h["origin_mm"]) + sum(columns[:, w] * spacing[w] * (size[w] - 1) for w in range(3) if flips[w])
    columns = columns * np.where(flips, -1.0, 1.0)
    out = array.transpose([2 - axis_of[w] for w in (2, 1, 0)])  # index axis a is array axis 2 - a
    out = out[tuple(slice(None, None, -1 if flips[w] else 1) for w in (2, 1, 0))]
    return h | {"size": size, "spacing_mm": spacing, "origin_mm": (origin + 0.0).tolist(), "direction": (columns + 0.0).ravel().tolist()}, out


def nifti(array: np.ndarray, spacing: list[float], origin: list[float] = (0, 0, 0), direction: list[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1), level: int = 1) -> bytes:
    """A zipped NIfTI-1 file of an array indexed [z, y, x]; the rest in x, y, z order and LPS world axes."""
    code = {v: k for k, v in NIFTI_TYPES.items()}[array.dtype.str[1:]]
    head = bytearray(NIFTI_DATA)
    struct.pack_into("<i", head, 0, NIFTI_HEAD)
    struct.pack_into("<8h", head, 40, 3, *array.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, array.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, NIFTI_DATA, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    ras = np.array([-1.0, -1.0, 1.0])
    rows = np.concatenate([np.array(direction, dtype=np.float64).reshape(3, 3) * np.array(spacing), np.array(origin, dtype=np.float64)[:, None]], axis=1) * ras[:, None]
    struct.pack_into("<12f", head, 280, *(rows + 0.0).ravel())
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + array.astype(array.dtype.newbyteorder("<")).tobytes(), level, mtime=0)


def nrrd(array: np.ndarray, spacing: list[float], origin: list[float] = (0, 0, 0), direction: list[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1)) -> bytes:
    """A zipped NRRD file, as `nifti`; of [z, y, x, channel] with the channels first in the file."""
    columns = np.array(direction, dtype=np.float64).reshape(3, 3) * np.array(spacing)
    vector = lambda v: "(" + ",".join(repr(float(x)) for x in v) + ")"
    sizes = ([array.shape[3]] if array.ndim == 4 else []) + [*array.shape[2::-1]]
    head = ["NRRD0004", f"type: {NRRD_TYPES[array.dtype.str[1:]][-1]}", f"dimension: {len(sizes)}", "space: left-posterior-superior", f"sizes: {' '.join(map(str, sizes))}"]
    head += [f"space directions: {'none ' * (array.ndim - 3)}{' '.join(vector(c) for c in columns.T)}", "endian: little", "encoding: gzip", f"space origin: {vector(origin)}", "", ""]
    buffer = io.BytesIO()
    with gzip.GzipFile(fileobj=buffer, mode="wb", mtime=0) as f:
        f.write(np.ascontiguousarray(array.astype(array.dtype.newbyteorder("<"))).tobytes())
    return "\n".join(head).encode() + buffer.getvalue()
