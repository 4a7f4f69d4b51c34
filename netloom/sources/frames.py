"""Bulk decoding of captured frames into protocol layers."""

from __future__ import annotations

from socket import AF_INET, AF_INET6, inet_ntop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from netloom.functions.scalars import endpoint, icmp_reason
from netloom.sources.codecs import CUT_OFF, NO_PLACE, Payloads, end_texts, explode_columns

# Link types, EtherTypes and IP protocol numbers that are told apart.
LINK_ETHERNET, LINK_TOKEN, LINK_COOKED = 1, 6, 113
LINKS_RAW = (12, 14, 101)
STACKED_TAGS = (0x88A8, 0x9100)
VLAN_TAG = 0x8100
ETHER_IP = (0x0800, 0x86DD)
LEAST_ETHER_TYPE = 0x0800  # smaller numbers are lengths
ETHER_NAMES = {
    0x8035: "a", 0x0806: "A", 0x0842: "W", 0x8137: "X", 0x8138: "X", 0x888E: "E", 0x8863: "P", 0x8864: "P",
}
IP_NAMES = {1: "i", 4: "4", 6: "T", 17: "U", 41: "6", 58: "I"}
TUNNELS = (4, 41)
PROTO_TCP, PROTO_UDP = 6, 17

LAYER = (
    "layer string, length long, hdr_length long, ip_protocol int, app_protocol string, "
    "src string, dst string, port_src int, port_dst int, tcp_flags int, vlan int"
)
FIELDS = [f.split()[0] for f in LAYER.split(", ")]
LAYERS = f"layers array<struct<{', '.join(': '.join(f.split()) for f in LAYER.split(', '))}>>"


LETTERS = pa.array([None, *map(chr, range(1, 128))], pa.string())


class Layers:
    """Layers found so far, column by column: a block of rows per round of the walk."""

    # Column and what it holds where nothing is known; letters by code, ends by place in the bytes.
    BLANK = {
        "layer": 0, "length": 0, "hdr_length": 0, "ip_protocol": 0, "app_protocol": 0, "src": NO_PLACE, "dst": NO_PLACE,
        "width": 0, "port_src": 0, "port_dst": 0, "tcp_flags": 0, "vlan": 0,
    }

    def __init__(self):
        self.owners, self.blocks = [], []

    def add(self, owner: np.ndarray, layer: str, length: np.ndarray) -> dict[str, np.ndarray]:
        """A block with the layer and its length filled in; the caller sets the rest."""
        block = {c: np.full(len(owner), blank, np.int64) for c, blank in self.BLANK.items()}
        block["layer"][:], block["length"] = ord(layer), length
        self.owners.append(owner)
        self.blocks.append(block)
        return block

    def array(self, messages: Payloads, of: np.ndarray, form: pa.DataType) -> pa.Array:
        """A list of layers, outermost first, for each of the messages `of`."""
        owner = np.concatenate([*self.owners, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")  # rounds go inwards
        found = {c: np.concatenate([*(b[c] for b in self.blocks), np.zeros(0, np.int64)])[order] for c in self.BLANK}
        fields = []
        for name, kind in zip(FIELDS, form.value_type):
            if name in ("src", "dst"):
                fields.append(end_texts(messages, found[name], found["width"]))
            elif name in ("layer", "app_protocol"):
                fields.append(LETTERS.take(pa.array(found[name])))
            else:
                fields.append(pa.array(found[name]).cast(kind.type))
        counts = np.bincount(owner, minlength=len(messages.starts))[of]
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(form.value_type)), type=form)


def _link_layers(messages: Payloads, owner: np.ndarray, links: np.ndarray, layers: Layers) -> tuple[np.ndarray, np.ndarray]:
    """The outer layers of frames with a link header; the frames that carry an IP packet, and where it starts."""
    start, stop = messages.starts[owner], messages.ends[owner]
    carriers, starts = [owner[np.isin(links, LINKS_RAW)]], [start[np.isin(links, LINKS_RAW)]]
    kinds = (("E", np.isin(links, (LINK_ETHERNET, LINK_TOKEN)), 12), ("S", links == LINK_COOKED, 14))
    other = ~np.isin(links, (LINK_ETHERNET, LINK_TOKEN, LINK_COOKED, *LINKS_RAW))
    layers.add(owner[other], "?", (stop - start)[other])
    for letter, mine, type_at in kinds:
        first, end = start[mine], stop[mine]
        block = layers.add(owner[mine], letter, end - first)
        rows = np.flatnonzero(end - first >= type_at + 2)
        block["app_protocol"][rows], block["width"][rows] = ord("?"), 6
        block["src"][rows] = first[rows] + 6
        if letter == "E":
            block["dst"][rows] = first[rows]
        at, final = first + type_at, np.full(len(first), NO_PLACE)
        # All frames pass one tag a round; frames that end inside the tags drop out.
        while len(rows):
            kind = messages.number(at[rows], 2)
            stacked = np.isin(kind, STACKED_TAGS)
            final[rows[~stacked]] = at[rows[~stacked]]
            rows = rows[stacked]
            at[rows] += 4
            rows = rows[at[rows] + 2 <= end[rows]]
        rows = np.flatnonzero(final != NO_PLACE)
        tagged = rows[messages.number(final[rows], 2) == VLAN_TAG]
        final[tagged[final[tagged] + 4 > end[tagged]]] = NO_PLACE
        tagged = tagged[final[tagged] != NO_PLACE]
        if letter == "E":
            block["vlan"][tagged] = messages.number(final[tagged] + 2, 2)
        final[tagged] += 4
        final[tagged[final[tagged] + 2 > end[tagged]]] = NO_PLACE
        rows = np.flatnonzero(final != NO_PLACE)
        kind = messages.number(final[rows], 2)
        is_ip = (kind < LEAST_ETHER_TYPE) | np.isin(kind, ETHER_IP)
        block["app_protocol"][rows] = np.where(is_ip, ord("I"), _letters(kind, ETHER_NAMES))
        carriers.append(owner[mine][rows[is_ip]])
        starts.append(final[rows[is_ip]] + 2)
    return np.concatenate(carriers), np.concatenate(starts)


def _letters(numbers: np.ndarray, names: dict[int, str]) -> np.ndarray:
    """Code of the letter of each number, of ? for others."""
    found = np.full(len(numbers), ord("?"), np.int64)
    for number, letter in names.items():
        found[numbers == number] = ord(letter)
    return found


def _ip_heads(messages: Payloads, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of IP packets at the places: version (0 if cut off), whether the head is whole, its bytes, the protocol."""
    size = stop - at
    version = np.zeros(len(at), np.int64)
    rows = np.flatnonzero(size >= 20)
    version[rows] = messages.flat[at[rows]] >> 4
    version[(version == 6) & (size < 40)] = 0
    whole = (version == 4) | (version == 6)
    header, protocol = np.where(version == 6, 40, 0), np.zeros(len(at), np.int64)
    v4, rows = np.flatnonzero(version == 4), np.flatnonzero(whole)
    header[v4] = (messages.flat[at[v4]] & 15).astype(np.int64) * 4
    protocol[rows] = messages.flat[at[rows] + np.where(version[rows] == 4, 9, 6)]
    return version, whole, header, protocol


def _ip_layers(messages: Payloads, owner: np.ndarray, at: np.ndarray, layers: Layers) -> None:
    """IP packets and the packets they carry: all frames go one layer inwards a round."""
    while len(owner):
        stop = messages.ends[owner]
        block = layers.add(owner, "I", stop - at)
        version, whole, header, protocol = _ip_heads(messages, at, stop)
        block["ip_protocol"] = version
        block["hdr_length"] = header
        block["app_protocol"] = np.where(whole, _letters(protocol, IP_NAMES), 0)
        block["width"] = np.where(version == 4, 4, 16)
        block["src"] = np.where(whole, at + np.where(version == 4, 12, 8), NO_PLACE)
        block["dst"] = np.where(whole, at + np.where(version == 4, 16, 24), NO_PLACE)
        body = np.minimum(at + header, stop)
        room = stop - body
        tcp = whole & (protocol == PROTO_TCP)
        block["app_protocol"][tcp & (room < 14)] = ord("?")
        rows = np.flatnonzero(tcp & (room >= 14))
        block["hdr_length"][rows] += (messages.flat[body[rows] + 12] >> 4).astype(np.int64) * 4
        block["tcp_flags"][rows] = messages.flat[body[rows] + 13]
        udp = whole & (protocol == PROTO_UDP)
        block["hdr_length"][udp & (room >= 8)] += 8
        rows = np.sort(np.concatenate([rows, np.flatnonzero(udp & (room >= 4))]))
        block["port_src"][rows] = messages.number(body[rows], 2)
        block["port_dst"][rows] = messages.number(body[rows] + 2, 2)
        # A head of no length carries nothing but itself.
        inner = whole & np.isin(protocol, TUNNELS) & (header > 0)
        owner, at = owner[inner], body[inner]


def _read_layers(messages: Payloads, links: pa.Array, form: pa.DataType) -> tuple[np.ndarray, list[pa.Array]]:
    messages.reject(links.is_null().to_numpy(zero_copy_only=False), "link type is missing")
    owner = np.flatnonzero(messages.good())
    links = links.fill_null(NO_PLACE).to_numpy(zero_copy_only=False)
    layers = Layers()
    _ip_layers(messages, *_link_layers(messages, owner, links[owner], layers), layers)
    return owner, [layers.array(messages, owner, form)]


def _form() -> pa.DataType:
    return to_arrow_type(_parse_datatype_string(LAYERS).fields[0].dataType)


def frame_layers(datalink: int, frame: bytes) -> list[dict]:
    """The layers of one frame, outermost first."""
    _, (found,) = _read_layers(Payloads(pa.array([frame], pa.binary())), pa.array([datalink], pa.int32()), _form())
    return found[0].as_py()


def decode_packets(df: DataFrame, rejected: bool = False) -> DataFrame:
    """Frames (ts, iface, direction, datalink, frame, ...) with their `layers`, outermost first.

    A frame that is cut off or of an unknown link type has the layers that can be
    read, so only rows without a frame or a link type are `rejected`.
    """
    form = _form()

    def decode(frames: Payloads, links: pa.Array) -> tuple:
        return _read_layers(frames, links, form)

    return explode_columns(df, decode, LAYERS, rejected, ("frame", "datalink"))


def innermost(decoded: DataFrame) -> DataFrame:
    """Decoded frames as packets of the innermost layer, for the packet operators."""
    inner, outer = F.element_at("layers", -1), F.element_at("layers", 1)
    above = F.slice("layers", 1, F.size("layers") - 1)
    carried = [c for c in decoded.columns if c != "layers"]
    flat = decoded.select(
        *carried,
        *[inner[c].alias(c) for c in FIELDS if c not in ("length", "vlan")],
        outer["length"].alias("length"),
        F.exists(above, lambda x: (x["layer"] == "I") & x["ip_protocol"].isin(4, 6)).alias("tunnel"),
    )
    return flat.select(
        *carried, "length", "layer", "hdr_length", "ip_protocol", "app_protocol", "tcp_flags", "tunnel",
        endpoint("local").alias("addr_local"), endpoint("remote").alias("addr_remote"),
        endpoint("local", "port_src", "port_dst").alias("port_local"),
        endpoint("remote", "port_src", "port_dst").alias("port_remote"),
    )


# Message type of "unreachable" by protocol letter; the quoted
# packet starts 8 bytes into the message.
UNREACHABLE = {"i": 3, "I": 1}
QUOTE_AT = 8
NO_REFUSAL = "code is no refusal"
NAK = "family int, code int, address string, local_port int, remote_port int"


def _read_naks(messages: Payloads, letters: pa.Array) -> tuple[np.ndarray, list]:
    messages.reject(letters.is_null().to_numpy(zero_copy_only=False), "protocol is missing")
    which = messages.headed(QUOTE_AT)
    first = messages.starts[which]
    letters = np.array(letters.fill_null("").to_pylist(), object)[which]
    wanted = np.full(len(which), NO_PLACE)
    for letter, message in UNREACHABLE.items():
        wanted[letters == letter] = message
    messages.reject(which[messages.flat[first] != wanted], "message is not unreachable")
    stays = messages.good()[which]
    which, first, letters = which[stays], first[stays], letters[stays]
    at, stop = first + QUOTE_AT, messages.ends[which]
    version, whole, header, protocol = _ip_heads(messages, at, stop)
    messages.reject(which[~whole], "quoted packet cannot be read")
    rows = np.flatnonzero(version == 4)
    part = np.zeros(len(which), bool)
    part[rows] = (messages.number(at[rows] + 6, 2) & 0x1FFF) > 0
    messages.reject(which[part], "quoted packet is a fragment")
    messages.reject(which[whole & (protocol != PROTO_TCP)], "quoted packet is not TCP")
    messages.reject(which[at + header + QUOTE_AT > stop], CUT_OFF)
    rows = np.flatnonzero(messages.good()[which])
    which, at, letters = which[rows], at[rows], letters[rows]
    version, ports = version[rows], at + header[rows]
    remote = end_texts(messages, at + np.where(version == 4, 16, 24), np.where(version == 4, 4, 16))
    family = np.where(letters == "i", 4, 6)
    local, far = (messages.number(ports + k, 2).astype(np.int32) for k in (0, 2))
    return which, [family, messages.flat[first[rows] + 1].astype(np.int32), remote, local, far]


def decode_icmp_nak(df: DataFrame, rejected: bool = False) -> DataFrame:
    """Refusals in ICMP messages (app_protocol i or I, body): reason, remote end and local port.

    Other messages, quotes of other protocols, fragments and the request to
    fragment are no refusals; `rejected` gives them with what they lack.
    """
    inputs = ("body", "app_protocol")
    problem = F.when(icmp_reason("family", "code").isNull(), NO_REFUSAL)
    if rejected:
        every = explode_columns(df, _read_naks, NAK, None, inputs)
        wrong = F.coalesce("problem", problem).alias("reason")
        return every.select(*df.columns, wrong).where(F.col("reason").isNotNull())
    found = explode_columns(df, _read_naks, NAK, False, inputs)
    return found.where(problem.isNull()).withColumn("reason", icmp_reason("family", "code")).drop("family", "code")
