"""WARC derivatives: response records to linked metadata and plain-text conversion records.

``response_records`` turns pages into WARC response records, ``derive`` builds from every response a
``metadata`` record (facts about the capture and the source's header lines) and a ``conversion``
record (its text as text/plain). Both name the response in WARC-Refers-To and keep its target URI,
date and digests; the conversion also names the metadata record. Ids are urn:uuid values made from
the response's id, so that reruns give the same ones. ``write_warc`` and ``read_warc`` store and load
folders of ``.warc.gz`` files, a gzip member per record; what is read back can be derived again.

Every record is a row of its own work: nothing is shuffled, and a lost task is run again. A block and
a payload are hashed once, the markup goes in one pass.

Edge cases. A null html is an empty body; a null url an empty target URI; a null block an empty one.
Responses whose block has no blank line have an empty payload. An empty text still gives a conversion
record of length 0, as does a payload of a type that isn't text (images and the like). Bytes that
aren't of the named character set become U+FFFD; an unknown set is read as UTF-8. Content and transfer
encodings are not undone. Repeated rows give repeated records. Extra columns are dropped. Where
records become bytes, control characters and spaces in a target URI are percent-encoded and those in
other fields become spaces, so that a value can't end its line.

Damaged files never fail a job: what can't be read is left out, and reading goes on with the next record that
can. That holds for gzip members with wrong bytes (up to the next member; what a member gave before its damage
stays, whole records only), for padding and other bytes between members or records, for a Content-Length that is
missing, no number, or not followed by a line end, and for a record that the file breaks off in. Lines may end in LF
alone. Overwriting deletes only files of the names that this module writes, after the new ones are in place; who reads in
between may see both.
"""

from __future__ import annotations

import hashlib
import html as entities
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
VERSION = "WARC/1.1"
#: The columns of ``derive`` after the key.
DERIVED = {
    "warc_type": "string", "record_id": "string", "refers_to": "string", "concurrent_to": "string", "target_uri": "string", "warc_date": "string", "content_type": "string",
    "content_length": "long", "block_digest": "string", "source_payload_digest": "string", "source_block_digest": "string", "block": "string",
}
#: Columns of records in files and their fields. Other fields of a file are in ``fields``.
FIELDS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest",
    "source_payload_digest": "Source-Payload-Digest", "source_block_digest": "Source-Block-Digest",
}
STORED = ", ".join(f"{name} string" for name in FIELDS) + ", fields map<string,string>, block binary"


def urn(seed: Column) -> Column:
    """A stable urn:uuid from a string."""
    h = F.md5(seed.cast("binary"))
    return F.concat(F.lit("urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ""))))


def response_records(pages: DataFrame, key: str = "page_id", date: str = DATE) -> DataFrame:
    """One response record per page: key, warc_type, record_id, target_uri, warc_date, content_type and
    block (the HTTP message)."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    uri = F.coalesce("url", F.lit(""))
    return pages.select(
        F.col(key),
        F.lit("response").alias("warc_type"),
        urn(F.concat_ws("|", F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), uri)).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.concat(head, body).alias("block"),
    )


# -- One response ----------------------------------------------------------------------------------

#: A < begins markup only before a letter, a slash and a letter, ! or ?. A quoted value after = may hold a >.
_MARKUP = re.compile(r"<(?:((?i:script|style))(?=[\s/>]).*?(?:</(?i:\1)\b[^>]*>|\Z)|/?[a-zA-Z](?:[^<>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+>|!--.*?-->|[!?][^<>]*>)", re.S)
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
_STATUS = re.compile(r"HTTP/\S+ (\d{3})")
_FOLDED = re.compile(r"\r?\n[ \t]+")
_CHARSET = re.compile(r";\s*charset\s*=\s*[\"']?([^\s;\"']+)", re.I)
#: Types whose payload is text.
_TEXTUAL = re.compile(r"text/|.*(?:html|xml|json|javascript)|$")


def _character(found: re.Match) -> str:
    name = found[0][1:]
    value = entities.unescape(found[0]) if name[0] == "#" else html5.get(name, found[0])
    return " " if value == "\xa0" else value


def plain_text(markup: str) -> bytes:
    """Markup to text in UTF-8: scripts, styles (to the end of the page if not closed) and comments go, tags are
    white space (a < that begins none is text), references that end in a semicolon are decoded (a no-break space is a space), white
    space is one space."""
    text = _MARKUP.sub(" ", markup) if "<" in markup else markup
    if "&" in text:
        text = _REFERENCE.sub(_character, text)
    return b" ".join(text.encode().split())  # of bytes only the six ASCII ones are white space


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _uuid(seed: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(seed.encode(), usedforsecurity=False).digest())}"


def _decoded(payload: bytes, kind: str) -> str:
    found = _CHARSET.search(kind)
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def derived(record_id: str, target_uri: str | None, date: str | None, block: bytes) -> list[tuple]:
    """The two records of a response, in the order of ``DERIVED``; blocks are UTF-8."""
    at = block.find(b"\r\n\r\n")
    head, payload = (block[:at], block[at + 4 :]) if at >= 0 else (block, b"")
    lines = [x for x in _FOLDED.sub(" ", head.decode("utf-8", "replace")).split(CRLF)[1:] if x]
    status = _STATUS.match(head.decode("latin-1"))
    kind = next((value.strip() for name, _, value in (x.partition(":") for x in lines) if name.strip().lower() == "content-type"), "")
    bare = kind.partition(";")[0].strip().lower()
    of_block, of_payload = digest(block), digest(payload)
    facts = [("http-status", status[1] if status else ""), ("source-content-type", bare), ("source-payload-length", len(payload)), ("source-payload-digest", of_payload), ("source-block-digest", of_block)]
    metadata = "".join(f"{name}: {value}\r\n" for name, value in [*facts, *(("source-header", x) for x in lines)])
    text = plain_text(_decoded(payload, kind)) if _TEXTUAL.match(bare) else b""
    meta_id = _uuid(f"metadata|{record_id}")
    out = []
    for name, own, beside, media, body in (("metadata", meta_id, None, "application/warc-fields", metadata.encode()), ("conversion", _uuid(f"conversion|{record_id}"), meta_id, "text/plain", text)):
        out.append((name, own, record_id, beside, target_uri or "", date, media, len(body), digest(body), of_payload, of_block, body))
    return out


def derive(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows per response (record_id, target_uri, warc_date, block as text or bytes): a metadata and
    a conversion record, linked to it and to each other. ``key`` is a column that both carry on; with
    ``record_id``, as for records read from files, ``refers_to`` is it."""
    carried = [] if key == "record_id" else [key]
    rows = responses.select(*carried, "record_id", "target_uri", "warc_date", F.coalesce(F.col("block").cast("binary"), F.lit(b"")).alias("block"))
    types = [pa.int64() if kind == "long" else pa.string() for kind in DERIVED.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, uris, dates, blocks = (part.column(name).to_pylist() for name in ("record_id", "target_uri", "warc_date", "block"))
                made = [x for row in zip(ids, uris, dates, blocks, strict=True) for x in derived(*row)]
                twice = pa.array([i for i in range(part.num_rows) for _ in range(2)], pa.int64())
                first = [part.column(key).take(twice)] if carried else []
                yield pa.RecordBatch.from_arrays(first + [pa.array(v, t) for v, t in zip(zip(*made, strict=True), types, strict=True)], names=[*carried, *DERIVED])

    of_key = [f"`{key}` {responses.schema[key].dataType.simpleString()}"] if carried else []
    return rows.mapInArrow(run, ", ".join([*of_key, *(f"{name} {kind}" for name, kind in DERIVED.items())]))


# -- Files -----------------------------------------------------------------------------------------

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def serialised(record: dict) -> bytes:
    """A record's bytes: field lines, blank line, block and two line ends. Null fields are left out."""
    block = record.get("block")
    block = block.encode() if isinstance(block, str) else block or b""
    lines = [VERSION]
    for column, field in FIELDS.items():
        value = record.get(column)
        if value is None:
            continue
        value = _CONTROL.sub((lambda m: f"%{ord(m[0]):02X}") if column == "target_uri" else " ", value)
        lines.append(f"{field}: <{value}>" if column in ("record_id", "refers_to", "concurrent_to") else f"{field}: {value}")
    lines += [f"{_CONTROL.sub('-', k)}: {_CONTROL.sub(' ', v or '')}" for k, v in (record.get("fields") or ())]
    lines.append(f"Content-Length: {len(block)}")
    return CRLF.join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _unfolded(head: bytes) -> dict[str, str]:
    lines = re.split(r"\r?\n", _FOLDED.sub(" ", head.decode("utf-8", "replace")))
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


#: Between pieces of a file: what comes next doesn't follow on what came before.
BREAK = b""
_BEGIN, _HEAD_END = re.compile(rb"(?:\A|[\n\0])(?=WARC/\d)"), re.compile(rb"\r?\n\r?\n")
#: A head that is longer isn't one.
HEAD = 1 << 20


def parsed(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records from a file's decompressed bytes, as they come: no more than a record and a piece is
    held, as long as its length doesn't lie. An empty piece is a ``BREAK``."""
    held, ended, broken = bytearray(), False, False
    pieces = iter(pieces)

    def more() -> bool:
        """Another piece; False at the end of the file and at a break."""
        nonlocal ended, broken
        piece = next(pieces, None)
        ended, broken = piece is None, piece == BREAK
        held.extend(piece or b"")
        return bool(piece)

    while True:
        if broken or ended:
            # What is left of before: a record that can't go on is passed over, others in it may be whole.
            found = _BEGIN.search(held)
            if not found:
                if ended:
                    return
                held.clear()
                broken = False
                continue
        found = _BEGIN.search(held)
        if not found:
            del held[: max(0, len(held) - 8)]
            more()
            continue
        del held[: found.end()]
        while not (end := _HEAD_END.search(held)) and len(held) < HEAD and not (broken or ended) and more():
            pass
        if not end or end.start() > HEAD:
            del held[:5]  # no longer a beginning
            continue
        fields = _unfolded(bytes(held[: end.start()]))
        length, start = fields.pop("content-length", ""), end.end()
        if not re.fullmatch(r"[0-9]{1,18}", length):
            del held[: start - 1]
            continue
        size = int(length)
        while len(held) < start + size + 4 and not (broken or ended) and more():
            pass
        after = bytes(held[start + size : start + size + 4])
        if len(held) < start + size or after[:1] not in (b"", b"\r", b"\n"):
            del held[: start - 1]
            continue
        block = bytes(held[start : start + size])
        del held[: start + size]  # the line ends after it lead up to the next beginning
        row = {column: fields.pop(field.lower(), None) for column, field in FIELDS.items()}
        for column in ("record_id", "refers_to", "concurrent_to"):
            row[column] = row[column].strip("<>") if row[column] is not None else None
        yield row | {"fields": list(fields.items()), "block": block}


_MAGIC = b"\x1f\x8b\x08"


def inflated(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file of gzip members, or of one that isn't compressed, with a ``BREAK`` where a member is
    damaged or other bytes stand between members."""
    raw = stream.read(size)
    if raw[:2] != _MAGIC[:2]:
        while raw:
            yield raw
            raw = stream.read(size)
        return
    member, fresh = zlib.decompressobj(31), True  # fresh: ``raw`` is where the member begins
    while raw:
        try:
            made = member.decompress(raw, 4 << 20)
        except zlib.error:
            yield BREAK
            raw = raw[1:] if fresh else raw
            while (at := raw.find(_MAGIC)) < 0:
                following = stream.read(size)
                raw = raw[-2:] + following if following else b""
                if not following:
                    return
            raw, member, fresh = raw[at:], zlib.decompressobj(31), True
            continue
        if made:
            yield made
        fresh = False
        if member.eof:
            raw = member.unused_data.lstrip(b"\0")
            while not raw and (raw := stream.read(size)):
                raw = raw.lstrip(b"\0")
            member, fresh = zlib.decompressobj(31), True
        else:
            raw = member.unconsumed_tail or stream.read(size)


def _store(path: str):
    """A file system and the path in it, for plain paths and for URIs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://|file:", path) else (fs.LocalFileSystem(), os.path.abspath(path))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class WarcSource(DataSource):
    """Folders of WARC files for ``spark.read.format("warc")`` and ``df.write.format("warc")``.

    A file is a task's work, read record by record. Tasks write into a folder of the job's own; only
    when all have ended the driver moves their files in place, so a lost or repeated task leaves none.
    The path must be one that all executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return STORED

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema.names, overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=False))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = _store(self.path)
        kinds = [pa.string()] * len(FIELDS) + [pa.map_(pa.string(), pa.string()), pa.binary()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in zip(names, kinds, strict=True)], names=names)
        names, rows, held = [*FIELDS, "fields", "block"], [], 0
        with store.open_input_stream(partition.path, compression=None) as stream:
            for row in parsed(inflated(stream)):
                rows.append(row)
                held += len(row["block"])
                if len(rows) == 256 or held > 8 << 20:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)


#: Names of the files that are written.
_OWN = re.compile(r"part-\d{6,}-[0-9a-f]{12}-\d+\.warc\.gz")


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        store, path = _store(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{self.job[:12]}-{task.taskAttemptId()}.warc.gz"
        store.create_dir(f"{path}/_{self.job}", recursive=True)
        with store.open_output_stream(f"{path}/_{self.job}/{name}", compression=None) as out:
            for batch in iterator:
                for at in range(0, batch.num_rows, 64):
                    for row in batch.slice(at, 64).to_pylist():
                        member = zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.write(member.compress(serialised(row)) + member.flush())
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        before = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and _OWN.fullmatch(x.base_name)] if self.overwrite else []
        for m in messages:
            if m is not None:
                store.move(f"{path}/_{self.job}/{m.name}", f"{path}/{m.name}")
        for old in before:
            store.delete_file(old)
        self._clear(store, path)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, path: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{path}/_{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_{self.job}")


def write_warc(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records (of ``derive`` or ``response_records``) as ``.warc.gz`` files in the folder ``path``."""
    records.sparkSession.dataSource.register(WarcSource)
    kept = [c for c in records.columns if c in FIELDS or c in ("fields", "block")]
    rows = records.select(*kept)
    if "block_digest" not in kept:
        rows = rows.withColumn("block_digest", F.concat(F.lit("sha256:"), F.sha2(F.col("block").cast("binary"), 256)))
    rows.write.format("warc").mode(mode).save(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of a WARC file or of a folder's files (see ``STORED`` for the columns)."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


#: The same derivation for DuckDB, over the view ``pages``.
DERIVE_SQL = r"""
WITH responses AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS h FROM pages
), known AS (
  SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) || chr(13) || chr(10) || payload AS block,
    'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS rid FROM responses
), hashed AS (
  SELECT *, 'sha256:' || sha256(payload) AS pd, 'sha256:' || sha256(block) AS bd, md5('metadata|' || rid) AS mh, md5('conversion|' || rid) AS ch,
    regexp_replace(regexp_replace(regexp_replace(payload, '<(script|style)\b.*?</(script|style)\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<(?:/?[a-zA-Z](?:[^<>=]|=\s*"[^"]*"|=\s*''[^'']*''|=)*|[!?][^<>]*)>', ' ', 'g') AS x FROM known
), texts AS (
  SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS plain,
    'urn:uuid:' || substr(mh, 1, 8) || '-' || substr(mh, 9, 4) || '-' || substr(mh, 13, 4) || '-' || substr(mh, 17, 4) || '-' || substr(mh, 21, 12) AS mid,
    'urn:uuid:' || substr(ch, 1, 8) || '-' || substr(ch, 9, 4) || '-' || substr(ch, 13, 4) || '-' || substr(ch, 17, 4) || '-' || substr(ch, 21, 12) AS cid,
    'http-status: 200' || chr(13) || chr(10) || 'source-content-type: text/html' || chr(13) || chr(10) || 'source-payload-length: ' || strlen(payload) || chr(13) || chr(10) || 'source-payload-digest: ' || pd || chr(13) || chr(10) || 'source-block-digest: ' || bd || chr(13) || chr(10)
      || 'source-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-header: Content-Length: ' || strlen(payload) || chr(13) || chr(10) AS facts FROM hashed
), both_kinds AS (
  SELECT page_id, 'metadata' AS warc_type, mid AS record_id, rid AS refers_to, NULL::VARCHAR AS concurrent_to, target_uri, 'application/warc-fields' AS content_type, facts AS block, pd, bd FROM texts
  UNION ALL
  SELECT page_id, 'conversion', cid, rid, mid, target_uri, 'text/plain', plain, pd, bd FROM texts
)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type,
  strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, pd AS source_payload_digest, bd AS source_block_digest, block FROM both_kinds
"""
