"""Bulk decoding of probe messages from a table of binary payloads.

A landing table has one message per row (client, received, payload, ...). Each
decoder turns it into one row per record, in Arrow batches, all payloads of a
slice at once and with no state between payloads: a narrow job without a shuffle. A
message that cannot be read is left out whole; the same call with
`rejected=True` returns those messages, unchanged, with the reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from socket import AF_INET, AF_INET6, inet_ntop

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from netloom.functions.scalars import bit, saturate
from netloom.functions.times import to_abs_time

DAY_MS = 86_400_000  # Fixed value: records older than this are dropped.
MAX_LONG = 2**63 - 1


class Payloads:
    """The messages of a batch as one byte array, read column by column.

    A decoder works on all messages at once: `number` reads the same field of many
    places, and `reject` marks messages that cannot be read. The first reason
    given for a message stays; its records are left out whole.
    """

    def __init__(self, column: pa.Array):
        self.reasons = np.full(len(column), None, object)
        self.reject(column.is_null().to_numpy(zero_copy_only=False), "message is missing")
        whole = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = whole.buffers()[2]
        self.flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.starts, self.ends = offsets[:-1], offsets[1:]

    def reject(self, which: np.ndarray, reason: str) -> None:
        """Mark messages (a mask or places)."""
        places = np.flatnonzero(which) if which.dtype == bool else which
        places = places[[r is None for r in self.reasons[places]]] if len(places) else places
        self.reasons[places] = reason

    def good(self) -> np.ndarray:
        return np.equal(self.reasons, None)

    def headed(self, size: int) -> np.ndarray:
        """Messages that hold a head of `size` bytes; others are rejected."""
        self.reject(self.ends - self.starts < size, CUT_OFF)
        return np.flatnonzero(self.good())

    def bytes(self, at: np.ndarray, size: int) -> np.ndarray:
        """`size` bytes from each place, one row each."""
        return self.flat[at[:, None] + np.arange(size)] if len(at) else np.zeros((0, size), np.uint8)

    def number(self, at: np.ndarray, size: int) -> np.ndarray:
        """The unsigned number of `size` bytes at each place."""
        return self.bytes(at, size).view(f">u{size}").ravel().astype(f"u{size}")

    def stamps(self, which: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Stamps as longs; messages with one past them are rejected."""
        self.reject(np.unique(which[values > MAX_LONG]), "stamp out of range")
        return values.astype(np.int64)


CUT_OFF = "message is cut off"
SLICE_BYTES = 4_000_000  # Payload bytes that a task decodes at once.


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged lists of so many items: the list of each item, and its place in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _payload_slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False)
    cuts = np.unique(np.cumsum(sizes) // SLICE_BYTES, return_index=True)[1].tolist()
    for start, stop in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(start, stop - start)


def explode_columns(
    df: DataFrame, decode: Callable[..., tuple], ddl: str, rejected: bool | None = False, inputs=("payload",)
) -> DataFrame:
    """Replace the `inputs` by the records that `decode` finds, or give the `rejected` rows with the reason.

    `decode` takes the messages of the first input and the columns of the others; it returns
    the message of each record and the columns of `ddl`. With `rejected` None all rows come
    out as they are, with the records beside them, or else the `problem`.
    """
    tagged = rejected is None
    kept = [f for f in df.schema.fields if tagged or rejected or f.name not in inputs]
    found = [StructField("reason", StringType())] if rejected else _parse_datatype_string(ddl).fields
    found += [StructField("problem", StringType())] if tagged else []
    types = [to_arrow_type(f.dataType) for f in found]
    names = [f.name for f in (*kept, *found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _payload_slices(batch, inputs[0]):
                messages = Payloads(part.column(inputs[0]))
                origin, columns = decode(messages, *[part.column(c) for c in inputs[1:]])
                good = messages.good()
                bad = np.flatnonzero(~good)
                if rejected:
                    origin = bad
                    columns = [messages.reasons[origin].tolist()]
                elif not good.all():
                    stays = good[origin]
                    origin = origin[stays]
                    columns = [c.filter(pa.array(stays)) if isinstance(c, pa.Array) else c[stays] for c in columns]
                arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)]
                if tagged:
                    read = len(origin)
                    origin = np.concatenate([origin, bad])
                    arrays = [pa.concat_arrays([a, pa.nulls(len(bad), a.type)]) for a in arrays]
                    arrays.append(pa.array([None] * read + messages.reasons[bad].tolist(), pa.string()))
                index = pa.array(origin, pa.int64())
                arrays = [*[part.column(f.name).take(index) for f in kept], *arrays]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, StructType([*kept, *found]))


def _texts(addresses: np.ndarray, family: int) -> np.ndarray:
    """Text of addresses given as rows of bytes; each distinct address is written once."""
    raw = np.ascontiguousarray(addresses).view(np.dtype((np.void, addresses.shape[1]))).ravel().tolist()
    known = {a: inet_ntop(family, a) for a in set(raw)}
    return np.array([known[a] for a in raw], object)


# Writers of an end by its width in bytes.
END_TEXT = {6: lambda raw: raw.hex(":"), 4: lambda raw: inet_ntop(AF_INET, raw), 16: lambda raw: inet_ntop(AF_INET6, raw)}
NO_PLACE = -1


def end_texts(messages: Payloads, places: np.ndarray, widths: np.ndarray) -> pa.Array:
    """Texts of the ends at the places, NULL for no place; each distinct end is written once."""
    texts, row, filled = [pa.array([], pa.string())], np.zeros(len(places), np.int64), 0
    known = places != NO_PLACE
    for width, write in END_TEXT.items():
        own = np.flatnonzero(known & (widths == width))
        raw = np.ascontiguousarray(messages.bytes(places[own], width))
        ends = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(own), [None, pa.py_buffer(raw)])
        distinct = ends.dictionary_encode()
        written = pa.array([write(e) for e in distinct.dictionary.to_pylist()], pa.string())
        texts.append(written.take(distinct.indices))
        row[own] = filled + np.arange(len(own))
        filled += len(own)
    return pa.concat_arrays(texts).take(pa.array(row, mask=~known))


def byte_strings(messages: Payloads, places: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The byte strings of so many bytes at the places, NULL for no place."""
    known = places != NO_PLACE
    lengths = np.where(known, lengths, 0)
    owner, place = _spread(lengths)
    data = messages.flat[places[owner] + place]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    parts = [pa.py_buffer(np.packbits(known, bitorder="little")), pa.py_buffer(offsets), pa.py_buffer(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), parts).cast(pa.binary())


def _replaced(raw: pa.Array) -> pa.Array:
    """Byte strings as texts; what is no UTF-8 is replaced."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in raw.to_pylist()], pa.string())


class Cursors:
    """A place in each message of a slice, for records of variable length.

    All messages read the same field at once. A message that ends before is
    rejected and takes no further part.
    """

    def __init__(self, messages: Payloads):
        self.messages, self.at, self.live = messages, messages.starts.copy(), messages.good()

    def reject(self, which: np.ndarray, reason: str) -> None:
        self.messages.reject(which, reason)
        self.live[which] = False

    def alive(self, which: np.ndarray) -> np.ndarray:
        return which[self.live[which]]

    def take(self, which: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
        """Of the messages, those with `size` more bytes, and where these start."""
        after = self.at[which] + size
        whole = after <= self.messages.ends[which]
        self.reject(which[~whole], CUT_OFF)
        which, after = which[whole], after[whole]
        start, self.at[which] = self.at[which], after
        return which, start

    def text(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the messages, those with a whole string, where it starts and its length, which stands in front."""
        which, start = self.take(which, LENGTH_BYTES)
        length = self.messages.number(start, LENGTH_BYTES).astype(np.int64)
        read, start = self.take(which, length)
        return read, start, length[self.live[which]]


LENGTH_BYTES = 4


class Records:
    """Fields of one record in each message, kept when the record is whole."""

    def __init__(self, messages: Payloads, *names: str):
        self.now = {c: np.full(len(messages.starts), NO_PLACE) for c in names}
        self.owners, self.kept = [], {c: [] for c in names}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.now[name]

    def keep(self, which: np.ndarray) -> None:
        """Keep the records of these messages and start anew."""
        self.owners.append(which)
        for name, values in self.now.items():
            self.kept[name].append(values[which])

    def clear(self, *names: str) -> None:
        for name in names:
            self.now[name][:] = NO_PLACE

    def gathered(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Message and fields of all records, in the order of the messages."""
        none = [np.zeros(0, np.int64)]
        owner = np.concatenate([*self.owners, *none])
        order = np.argsort(owner, kind="stable")
        return owner[order], {c: np.concatenate([*kept, *none])[order] for c, kept in self.kept.items()}


# The flow message (configuration, clock) and its record before the two addresses.
FLOW_HEAD_BYTES = 12
FLOW_COUNTS = ("count_in", "count_out", "size_in", "size_out")
FLOW_TIMES = ("start_in", "start_out", "stop_in", "stop_out")
FLOW_DTYPE = np.dtype(
    [("flags", "u1"), ("count_in", ">u4"), ("count_out", ">u4"), ("size_in", ">u8"), ("size_out", ">u8")]
    + [("port_local", ">u2"), ("port_remote", ">u2"), *[(c, ">u8") for c in FLOW_TIMES]]
)
FLOW_BYTES = FLOW_DTYPE.itemsize
# Bits of the flags.
FLOW_V6, FLOW_UDP = 1, 2
FLOW_EVENTS = {"seen_start_in": 4, "seen_start_out": 8, "seen_end_in": 16, "seen_end_out": 32, "seen_rst": 64}


def decode_flows(df: DataFrame, conf_id: int | None = None, max_records: int | None = None, rejected: bool = False) -> DataFrame:
    """Flow records of messages (client, received, payload).

    Messages of another configuration, and those with more than `max_records`
    fresh records, are rejected.
    """

    def decode(messages: Payloads) -> tuple:
        which = messages.headed(FLOW_HEAD_BYTES)
        head = messages.starts[which]
        if conf_id is not None:
            messages.reject(which[messages.number(head, 4) != conf_id], "another configuration")
        clock = np.zeros(len(messages.starts), np.int64)
        clock[which] = messages.stamps(which, messages.number(head + 4, 8))
        # All messages go on by one record a round; the flags of a record tell its length.
        owner, places, at, active = [], [], head + FLOW_HEAD_BYTES, which
        while len(active):
            more = at < messages.ends[active]
            at, active = at[more], active[more]
            size = np.where(messages.flat[at] & FLOW_V6, FLOW_BYTES + 32, FLOW_BYTES + 8)
            whole = at + size <= messages.ends[active]
            messages.reject(active[~whole], CUT_OFF)
            owner.append(active[whole])
            places.append(at[whole])
            at, active = (at + size)[whole], active[whole]
        owner = np.concatenate([*owner, np.zeros(0, np.int64)])
        places = np.concatenate([*places, np.zeros(0, np.int64)])
        records = messages.bytes(places, FLOW_BYTES).view(FLOW_DTYPE).ravel()
        times = [messages.stamps(owner, records[c].astype("u8")) for c in FLOW_TIMES]
        oldest = clock[owner] - DAY_MS
        fresh = np.logical_and.reduce([(t == 0) | (t >= oldest) for t in times])
        if max_records is not None:
            messages.reject(np.bincount(owner[fresh], minlength=len(messages.starts)) > max_records, "too many records")
        order = np.flatnonzero(fresh)
        order = order[np.argsort(owner[order], kind="stable")]
        owner, places, records = owner[order], places[order], records[order]
        v6 = (records["flags"] & FLOW_V6) != 0
        texts = np.empty((2, len(order)), object)
        for is_v6, length, family in ((False, 4, AF_INET), (True, 16, AF_INET6)):
            own = np.flatnonzero(v6 == is_v6)
            both = messages.bytes(places[own] + FLOW_BYTES, 2 * length)
            texts[0, own], texts[1, own] = _texts(both[:, :length], family), _texts(both[:, length:], family)
        counts = [np.minimum(records[c].astype("u8"), MAX_LONG).astype(np.int64) for c in FLOW_COUNTS]
        ports = [records[c].astype(np.int32) for c in ("port_local", "port_remote")]
        columns = [clock[owner], records["flags"].astype(np.int32), *counts, *ports, *[t[order] for t in times], texts[0], texts[1]]
        return owner, columns

    raw = explode_columns(
        df, decode,
        "clock long, flags int, count_in long, count_out long, size_in long, size_out long, port_local int, port_remote int, "
        "t_start_in long, t_start_out long, t_stop_in long, t_stop_out long, ip_local string, ip_remote string",
        rejected,
    )
    if rejected:
        return raw
    moment = lambda c: to_abs_time(F.col("received"), F.col("clock"), F.col(f"t_{c}")).alias(c)
    return raw.select(
        "client", "ip_local", "ip_remote", "port_local", "port_remote",
        F.when(bit("flags", FLOW_UDP), "U").otherwise("T").alias("proto"),
        *[moment(c) for c in ("start_in", "start_out", "stop_in", "stop_out")],
        "size_in", "size_out", "count_in", "count_out",
        *[bit("flags", mask).alias(name) for name, mask in FLOW_EVENTS.items()],
    )


# The refused message starts with a clock; its record before the address.
REFUSED_DTYPE = np.dtype([("time", ">u8"), ("reason", "u1"), ("family", "u1"), ("local", ">u2"), ("remote", ">u2")])
REFUSED_BYTES = REFUSED_DTYPE.itemsize


def decode_refused(df: DataFrame, max_records: int | None = None, rejected: bool = False) -> DataFrame:
    """Refused connections of messages (client, received, payload)."""

    def decode(messages: Payloads) -> tuple:
        which = messages.headed(8)
        clock = np.zeros(len(messages.starts), np.int64)
        owner, places, at, active = [], [], messages.starts[which] + 8, which
        sent = messages.number(messages.starts[which], 8)
        while len(active):
            more = at < messages.ends[active]
            at, active = at[more], active[more]
            whole = at + REFUSED_BYTES <= messages.ends[active]
            messages.reject(active[~whole], CUT_OFF)
            at, active = at[whole], active[whole]
            size = np.where(messages.flat[at + 9] == 4, 4, 16) + REFUSED_BYTES
            whole = at + size <= messages.ends[active]
            messages.reject(active[~whole], CUT_OFF)
            owner.append(active[whole])
            places.append(at[whole])
            at, active = (at + size)[whole], active[whole]
        owner = np.concatenate([*owner, np.zeros(0, np.int64)])
        places = np.concatenate([*places, np.zeros(0, np.int64)])
        # A message without records needs no clock.
        used = np.bincount(owner, minlength=len(clock))[which] > 0
        clock[which[used]] = messages.stamps(which[used], sent[used])
        records = messages.bytes(places, REFUSED_BYTES).view(REFUSED_DTYPE).ravel()
        age = clock[owner] - messages.stamps(owner, records["time"].astype("u8"))
        order = np.flatnonzero(age <= DAY_MS)
        order = order[np.argsort(owner[order], kind="stable")]
        owner, places, records, age = owner[order], places[order], records[order], age[order]
        if max_records is not None:
            messages.reject(np.bincount(owner, minlength=len(clock)) > max_records, "too many records")
        texts = np.empty(len(order), object)
        v4 = records["family"] == 4
        for is_v4, length, family in ((True, 4, AF_INET), (False, 16, AF_INET6)):
            own = np.flatnonzero(v4 == is_v4)
            texts[own] = _texts(messages.bytes(places[own] + REFUSED_BYTES, length), family)
        reasons = np.array([chr(c) for c in range(256)], object)[records["reason"]]
        return owner, [age, texts, records["local"].astype(np.int32), records["remote"].astype(np.int32), reasons]

    raw = explode_columns(df, decode, "age long, address string, local_port int, remote_port int, reason string", rejected)
    if rejected:
        return raw
    return raw.select(
        "client", _ago("received", "age").alias("timestamp"),
        "address", "local_port", "remote_port", "reason",
    )


def _ago(received: str, age_ms: str) -> Column:
    """`received` less an age in milliseconds."""
    return F.col(received) - F.make_dt_interval(secs=(F.col(age_ms) / 1000).cast("decimal(18,6)"))


# A honeypot record is age (4 bytes), event, family, number of details, code,
# from version 2 on a port (2 bytes), then the ends; event and detail names.
FAKE_HEAD_BYTES = {1: 8, 2: 10}
FAKE_EVENTS = ("connect", "disconnect", "lost", "extra", "timeout", "login")
FAKE_DETAILS = ("name", "password", "reason", "method", "uri", "host")
FAKE_V6 = 1


def _fake_logs(messages: Payloads, version: int, logins_only: bool, max_bytes: int | None) -> tuple[np.ndarray, list]:
    details = range(len(FAKE_DETAILS))
    ends = [f"{k}_at" for k in details] + [f"{k}_bytes" for k in details]
    rows = Records(messages, "head", "width", "remote", "local", *ends)
    if max_bytes is not None:
        messages.reject(messages.ends - messages.starts > 3 * max_bytes, "message is too long")
    cursors = Cursors(messages)
    kinds, left = np.zeros((2, len(messages.starts)), np.int64)
    active = np.flatnonzero(cursors.live)
    while True:
        active = active[cursors.at[active] < messages.ends[active]]
        if not len(active):
            break
        rows.clear("local", *ends)
        active, head = cursors.take(active, FAKE_HEAD_BYTES[min(version, 2)])
        rows["head"][active] = head
        rows["width"][active] = np.where(messages.flat[head + 5] == FAKE_V6, 16, 4)
        left[active] = messages.flat[head + 6]
        for end in ("remote", "local")[: 1 if version < 2 else 2]:
            active, start = cursors.take(active, rows["width"][active])
            rows[end][active] = start
        reading = active[left[active] > 0]
        while len(reading):
            reading, start = cursors.take(reading, 1)
            kinds[reading] = messages.flat[start]
            reading, start, length = cursors.text(reading)
            for k in details:
                own = kinds[reading] == k
                rows[f"{k}_at"][reading[own]], rows[f"{k}_bytes"][reading[own]] = start[own], length[own]
            left[reading] -= 1
            reading = reading[left[reading] > 0]
        active = cursors.alive(active)
        event = messages.flat[rows["head"][active] + 4]
        cursors.reject(active[event >= len(FAKE_EVENTS)], "unknown event")
        wanted = cursors.live[active]
        if logins_only:
            wanted &= event == FAKE_EVENTS.index("login")
        rows.keep(active[wanted])
        active = cursors.alive(active)
    owner, found = rows.gathered()
    head = found["head"]
    ports = pa.array(messages.number(head + 8, 2), pa.int32()) if version > 1 else pa.nulls(len(head), pa.int32())
    codes = pa.array([chr(c) for c in range(256)]).take(pa.array(messages.flat[head + 7]))
    events = pa.array([*FAKE_EVENTS, *[None] * (256 - len(FAKE_EVENTS))]).take(pa.array(messages.flat[head + 4]))
    addresses = [end_texts(messages, found[c], found["width"]) for c in ("remote", "local")]
    texts = [byte_strings(messages, found[f"{k}_at"], found[f"{k}_bytes"]) for k in details]
    return owner, [messages.number(head, 4).astype(np.int64), events, *addresses, ports, codes, *texts]


def decode_fake_logs(df: DataFrame, version: int = 2, servers: DataFrame | None = None, logins_only: bool = True, max_bytes: int | None = None, rejected: bool = False) -> DataFrame:
    """Honeypot events of messages (client, received, payload).

    Version 1 messages hold no port and no local address. Messages longer than
    three times `max_bytes` are rejected; other events than logins go unless asked for.
    """
    raw = explode_columns(
        df, lambda messages: _fake_logs(messages, version, logins_only, max_bytes),
        "age long, event string, remote string, local string, remote_port int, code string, "
        + ", ".join(f"{name} binary" for name in FAKE_DETAILS),
        rejected,
    )
    if rejected:
        return raw
    raw = raw.withColumn("timestamp", _ago("received", "age")).withColumn("reason", F.col("reason").cast("string"))
    columns = ["client", "timestamp", "event", "remote", "local", "remote_port"]
    if servers is None:
        return raw.select(*columns, "code", *FAKE_DETAILS)
    return raw.join(servers.select("code", "server"), "code").select(*columns, "server", *FAKE_DETAILS)


PING_BYTES = 4


def _hosts(messages: Payloads, hosts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """First host and number of hosts of each message, and all hosts; messages without are rejected."""
    messages.reject(hosts.is_null().to_numpy(zero_copy_only=False), "hosts are missing")
    counts = pc.list_value_length(hosts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = hosts.flatten()
    owner = np.repeat(np.arange(len(counts)), counts)
    messages.reject(np.unique(owner[flat.is_null().to_numpy(zero_copy_only=False)]), "hosts are missing")
    return np.cumsum(counts) - counts, counts, flat


def _pings(messages: Payloads, hosts: pa.Array) -> tuple[np.ndarray, list]:
    first, counts, flat = _hosts(messages, hosts)
    amounts = pc.struct_field(flat, "amount")
    none = amounts.is_null().to_numpy(zero_copy_only=False)
    messages.reject(np.unique(np.repeat(np.arange(len(counts)), counts)[none]), "hosts are missing")
    amounts = np.maximum(amounts.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
    rows, cursors = Records(messages, "host", "address", "bytes", "times", "amount"), Cursors(messages)
    for k in range(counts.max(initial=0)):
        active = np.flatnonzero(cursors.live & (counts > k))
        host = first + k
        active, start, length = cursors.text(active)
        rows["host"][active], rows["bytes"][active] = host[active], length
        rows["address"][active] = np.where(length > 0, start, NO_PLACE)
        rows["amount"][active] = np.where(length > 0, amounts[host[active]], 0)
        active, start = cursors.take(active, PING_BYTES * rows["amount"][active])
        rows["times"][active] = start
        rows.keep(active)
    owner, found = rows.gathered()
    spread, place = _spread(np.where(found["address"] == NO_PLACE, 0, found["bytes"]))
    foreign = messages.flat[found["address"][spread] + place] > 127
    messages.reject(np.unique(owner[spread[foreign]]), "address is no text")
    offsets = np.concatenate([[0], np.cumsum(found["amount"])])
    spread, place = _spread(found["amount"])
    times = messages.number(found["times"][spread] + PING_BYTES * place, PING_BYTES).astype(np.int64)
    addresses = _replaced(byte_strings(messages, found["address"], found["bytes"]))
    requests = pc.struct_field(flat, "request").take(pa.array(found["host"]))
    return owner, [requests, addresses, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(times))]


def decode_pings(df: DataFrame, rejected: bool = False) -> DataFrame:
    """Ping replies of messages (client, batch, hosts, payload).

    `hosts` lists the (request, amount) a message answers, in order. A reply is
    the address text (empty when the name did not resolve) and `amount` times.
    """
    return explode_columns(df, _pings, "request long, ip string, rtts array<long>", rejected, ("payload", "hosts"))


def _certs(messages: Payloads, hosts: pa.Array) -> tuple[np.ndarray, list]:
    first, counts, flat = _hosts(messages, hosts)
    details, params = (
        pc.struct_field(flat, c).fill_null(False).to_numpy(zero_copy_only=False) for c in ("want_details", "want_params")
    )
    texts = ("cipher", "proto", "value", "name", "expiry")
    rows = Records(messages, "host", "ord", *texts, *[f"{c}_bytes" for c in texts])
    cursors, links = Cursors(messages), np.zeros(len(counts), np.int64)

    def read(name: str, which: np.ndarray) -> None:
        which, start, length = cursors.text(which)
        rows[name][which], rows[f"{name}_bytes"][which] = start, length

    for k in range(counts.max(initial=0)):
        host = first + k
        rows.clear(*texts)
        active, start = cursors.take(np.flatnonzero(cursors.live & (counts > k)), 1)
        links[active], rows["host"][active] = messages.flat[start], host[active]
        active = active[links[active] > 0]
        for name in ("cipher", "proto"):
            read(name, cursors.alive(active[params[host[active]]]))
        for i in range(links[active].max(initial=0)):
            active = cursors.alive(active[links[active] > i])
            read("value", active)
            for name in ("name", "expiry"):
                read(name, cursors.alive(active[details[host[active]]]))
            active = cursors.alive(active)
            rows["ord"][active] = i
            rows.keep(active)
    owner, found = rows.gathered()
    known = {c: _replaced(byte_strings(messages, found[c], found[f"{c}_bytes"])) for c in texts}
    expiry = pc.if_else(pc.equal(known["expiry"], ""), None, known["expiry"])
    requests = pc.struct_field(flat, "request").take(pa.array(found["host"]))
    full = pc.greater(pc.utf8_length(known["value"]), FULL_CHARACTERS)
    return owner, [requests, known["cipher"], known["proto"], found["ord"].astype(np.int32), full, known["value"], known["name"], expiry]


FULL_CHARACTERS = 40  # Fixed value: longer values are certificates, shorter ones fingerprints.


def decode_certs(df: DataFrame, rejected: bool = False) -> DataFrame:
    """Certificate replies of messages (client, batch, hosts, payload), one row per chain link.

    `hosts` lists the (request, want_details, want_params) a message answers.
    """
    return explode_columns(
        df, _certs,
        "request long, cipher string, proto string, ord int, is_full boolean, value string, name string, expiry string",
        rejected, ("payload", "hosts"),
    )


# A bandwidth message is made of 64-bit numbers: stamp, number of
# windows, (length, in, out) per window, number of buckets, (kbit/s, seconds and
# bytes in, seconds and bytes out) per bucket.
WINDOW_NUMBERS, BUCKET_NUMBERS = 3, 5


def _bandwidth(messages: Payloads) -> tuple[np.ndarray, ...]:
    """Of the whole messages: place, start, stamp, windows, where the number of buckets stands, buckets."""
    which = messages.headed(16)
    start = messages.starts[which]
    size = messages.ends[which] - start
    numbers = (size // 8).astype(np.uint64)
    stamp = messages.stamps(which, messages.number(start, 8))
    windows = messages.number(start + 8, 8)
    whole = (size % 8 == 0) & (windows < numbers)
    after = 2 + WINDOW_NUMBERS * np.where(whole, windows, 0).astype(np.int64)
    whole &= after < numbers.astype(np.int64)
    buckets = messages.number(start + 8 * np.where(whole, after, 0), 8)
    whole &= buckets < numbers
    buckets = np.where(whole, buckets, 0).astype(np.int64)
    whole &= after + 1 + BUCKET_NUMBERS * buckets == numbers.astype(np.int64)
    messages.reject(which[~whole], CUT_OFF)
    return tuple(c[whole] for c in (which, start, stamp, windows.astype(np.int64), after, buckets))


def _lists(messages: Payloads, first: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Owner and columns of lists of `width` 64-bit numbers an item, which start at `first`."""
    owner, place = _spread(counts)
    at = first[owner] + 8 * width * place
    most = np.uint64(MAX_LONG)
    return owner, [np.minimum(messages.number(at + 8 * k, 8), most).astype(np.int64) for k in range(width)]


def _current(df: DataFrame, last: Column | None) -> DataFrame:
    """Answers that are not older than the snapshot before."""
    return df if last is None else df.where(F.col("stamp") >= last)


def decode_bandwidth(df: DataFrame, last: Column | None = None, rejected: bool = False) -> DataFrame:
    """Peak windows of bandwidth messages (client, payload); answers older than `last` go."""

    def decode(messages: Payloads) -> tuple:
        which, start, stamp, windows, _, _ = _bandwidth(messages)
        owner, columns = _lists(messages, start + 16, windows, WINDOW_NUMBERS)
        return which[owner], [stamp[owner], *columns]

    ddl = "stamp long, win_len long, in_max long, out_max long"
    raw = explode_columns(df if rejected else df.select("client", "payload"), decode, ddl, rejected)
    return raw if rejected else _current(raw, last)


def decode_bandwidth_buckets(df: DataFrame, last: Column | None = None, rejected: bool = False) -> DataFrame:
    """Speed buckets of bandwidth messages (client, payload)."""

    def decode(messages: Payloads) -> tuple:
        which, start, stamp, _, after, buckets = _bandwidth(messages)
        owner, columns = _lists(messages, start + 8 * (after + 1), buckets, BUCKET_NUMBERS)
        return which[owner], [stamp[owner], *columns]

    ddl = "stamp long, kbit long, in_time long, in_bytes long, out_time long, out_bytes long"
    raw = explode_columns(df if rejected else df.select("client", "payload"), decode, ddl, rejected)
    return raw if rejected else _current(raw, last)


# A count message is a 64-bit stamp, the number of interfaces,
# three 32-bit numbers per interface, then pairs of packets and bytes. More than
# 32 words of pairs are 64-bit numbers.
WIDE_COUNTS = 32
CAPTURES = ("captured", "dropped", "dropped_driver")


def _count_heads(messages: Payloads) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Messages with a head, their stamps, and where the interfaces end."""
    which = messages.headed(12)
    start = messages.starts[which]
    stamp = messages.stamps(which, messages.number(start, 8))
    return which, stamp, start + 12 + 12 * messages.number(start + 8, 4).astype(np.int64)


def decode_counts(df: DataFrame, last: Column | None = None, rejected: bool = False) -> DataFrame:
    """Packet counters of count messages (client, payload): position, count and size.

    All pairs of a message come out; those past the known types have no row in
    the dimension of count types.
    """

    def decode(messages: Payloads) -> tuple:
        which, stamp, at = _count_heads(messages)
        words = (messages.ends[which] - at) // 4
        messages.reject(which[words < 0], CUT_OFF)
        which, stamp, at, words = (c[words >= 0] for c in (which, stamp, at, words))
        width = np.where(words > WIDE_COUNTS, 8, 4)
        owner, place = _spread(np.where(width == 8, words // 4, words // 2))
        first = at[owner] + 2 * place * width[owner]
        pairs = np.zeros((2, len(owner)), np.int64)
        for size in (4, 8):
            own = np.flatnonzero(width[owner] == size)
            for k in range(2):
                numbers = messages.number(first[own] + k * size, size).astype(np.uint64)
                pairs[k, own] = np.minimum(numbers, np.uint64(MAX_LONG)).astype(np.int64)
        return which[owner], [stamp[owner], place.astype(np.int32), pairs[0], pairs[1]]

    raw = explode_columns(df if rejected else df.select("client", "payload"), decode, "stamp long, type int, count long, size long", rejected)
    return raw if rejected else _current(raw, last)


def decode_captures(df: DataFrame, last: Column | None = None, rejected: bool = False) -> DataFrame:
    """Capture statistics of count messages (client, payload) per interface."""

    def decode(messages: Payloads) -> tuple:
        which, stamp, at = _count_heads(messages)
        whole = at <= messages.ends[which]
        messages.reject(which[~whole], CUT_OFF)
        which, stamp, at = which[whole], stamp[whole], at[whole]
        owner, place = _spread((at - messages.starts[which] - 12) // 12)
        first = messages.starts[which][owner] + 12 + 12 * place
        numbers = [messages.number(first + 4 * k, 4).astype(np.int64) for k in range(len(CAPTURES))]
        return which[owner], [stamp[owner], place.astype(np.int32), *numbers]

    ddl = "stamp long, interface int, " + ", ".join(f"{c} long" for c in CAPTURES)
    rows = explode_columns(df if rejected else df.select("client", "payload"), decode, ddl, rejected)
    if rejected:
        return rows
    return _current(rows, last).withColumns({c: saturate(c, 31) for c in CAPTURES})
