"""The engine as a service: a JSON request on each line, a JSON response on each line, over streams or a local socket."""

from __future__ import annotations

import json
import socket
import socketserver
import threading
import time
from typing import BinaryIO

from .engine import LONGEST_REQUEST, Engine, handle


def serve(engine: Engine, source: BinaryIO, sink: BinaryIO) -> int:
    """Answer the requests of a stream until it ends, or until nobody reads the answers. How many were answered."""
    done = 0
    while line := source.readline(LONGEST_REQUEST + 1):
        whole = line
        while whole and not whole.endswith(b"\n"):
            whole = source.readline(LONGEST_REQUEST)  # the rest of a request that is too long, or the end
        if not line.strip():
            continue
        try:
            sink.write(handle(engine, line).encode() + b"\n")
            sink.flush()
        except (BrokenPipeError, ConnectionResetError):
            break
        done += 1
    return done


class Service(socketserver.ThreadingMixIn, socketserver.UnixStreamServer):
    """A local socket at a path; each connection is served by a thread of its own."""

    daemon_threads = True

    def __init__(self, engine: Engine, path: str):
        self.engine = engine
        super().__init__(path, _Connection)

    def start(self) -> Service:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.shutdown()
        self.server_close()


class _Connection(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        serve(self.server.engine, self.rfile, self.wfile)


class Client:
    """Requests to a service, one at a time whatever the number of threads that ask."""

    def __init__(self, path: str, timeout: float | None = None):
        self._lock, self._next = threading.Lock(), 0
        self._socket = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
        self._socket.settimeout(timeout)
        self._socket.connect(path)
        self._stream = self._socket.makefile("rwb")

    def request(self, op: str, **fields: object) -> dict:
        """The service's response; ValueError with what it says where it refuses."""
        with self._lock:
            self._next += 1
            line = json.dumps({"op": op, "id": self._next, **{k: v for k, v in fields.items() if v is not None}}).encode()
            if len(line) > LONGEST_REQUEST:
                raise ValueError("the request is too long")
            self._stream.write(line + b"\n")
            self._stream.flush()
            answer = self._stream.readline()
        if not answer:
            raise ConnectionError("the service has gone")
        found = json.loads(answer)
        if not found["ok"]:
            raise ValueError(found["error"])
        return found

    def status(self) -> dict:
        return self.request("status")

    def search(self, q: str, limit: int | None = None) -> dict:
        return self.request("search", q=q, limit=limit)

    def grep(self, pattern: str, mode: str | None = None, q: str | None = None, limit: int | None = None, per_file: int | None = None) -> dict:
        return self.request("grep", pattern=pattern, mode=mode, q=q, limit=limit, per_file=per_file)

    def await_ready(self, seconds: float = 60, every: float = 0.2) -> bool:
        """Whether the service said within some seconds that its tables can be read."""
        end = time.monotonic() + seconds
        while True:
            if self.status().get("ready"):
                return True
            if time.monotonic() >= end:
                return False
            time.sleep(every)

    def close(self) -> None:
        for it in (self._stream, self._socket):
            try:
                it.close()
            except OSError:
                pass

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
