"""Binary files in the shared folder, read and written by tasks.

Paths are URIs that pyarrow's file systems know (``file:``, ``hdfs:``, ``s3:``, ``gs:``, ``abfs:``)
or plain paths; Spark's ``s3a:`` and ``s3n:`` are the same stores as ``s3:``.
"""

import re


def _locate(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or ":" not in uri.split("/", 1)[0]:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def create(uri: str):
    """An output stream to a new file, folders included."""
    filesystem, path = _locate(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return filesystem.open_output_stream(path, compression=None)


def open_file(uri: str):
    """A file to read at any offset."""
    filesystem, path = _locate(uri)
    return filesystem.open_input_file(path)


def attempt_name() -> str:
    """A name no other attempt of any task takes: files of lost or repeated attempts are never referred to."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"part-{context.partitionId():06d}-{context.taskAttemptId():09d}"


def append(stream, path: str, offset: int, batch) -> tuple[str, int]:
    """Write a batch to the stream that began at ``path``; its label, by which it is read again, and the offset behind it."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    size = stream.write(sink.getvalue())
    return f"{path}|{offset}|{size}", offset + size


def load(label: str):
    """The batch that ``append`` wrote."""
    import pyarrow as pa

    path, offset, size = label.rsplit("|", 2)
    with open_file(path) as file:
        file.seek(int(offset))
        with pa.ipc.open_stream(file.read(int(size))) as reader:
            return reader.read_next_batch()
