"""Jobs that are tried again: how often, how long between, and after which errors.

Only errors of transport are worth another attempt: connections, timeouts, services that are away for a while. Malformed data, unknown
columns and settings that do not hold together fail at once, however deep in a job they come up.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.errors import PythonException
from pyspark.sql import DataFrame

from .errors import VicinalError
from .sources.shared import staged

R = TypeVar("R")

#: Classes of the JVM whose errors pass; subclasses count too.
TRANSPORT = (
    "java.net.SocketException", "java.net.SocketTimeoutException", "java.net.UnknownHostException", "java.net.http.HttpTimeoutException", "java.io.InterruptedIOException", "java.io.EOFException", "java.nio.channels.ClosedChannelException",
    "java.sql.SQLTransientException", "java.sql.SQLRecoverableException", "java.util.concurrent.TimeoutException", "org.apache.spark.shuffle.FetchFailedException",
)
#: Errors of Python workers come as text, the class at the start of a line.
WORKER = re.compile(r"^\s*(?:\w+\.)*(ConnectionError|ConnectionResetError|ConnectionRefusedError|ConnectionAbortedError|BrokenPipeError|TimeoutError)(:|$)", re.M)


def causes(error: BaseException):
    """The throwables behind an error of the JVM, outermost first."""
    at = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    for _ in range(50):
        if at is None:
            return
        yield at
        at = at.getCause()


def is_transport(error: BaseException) -> bool:
    """Whether another attempt may help."""
    if isinstance(error, VicinalError):
        return False
    if isinstance(error, (ConnectionError, TimeoutError)) or isinstance(error, PythonException) and WORKER.search(str(error)):
        return True
    for cause in causes(error):
        kind = cause.getClass()
        while kind is not None:
            if kind.getName() in TRANSPORT:
                return True
            kind = kind.getSuperclass()
        if "PythonException" in cause.getClass().getName() and WORKER.search(cause.getMessage() or ""):
            return True
    return False


@dataclass(frozen=True)
class Retry:
    """At most `attempts`; between them `first` seconds, then `factor` times the last wait up to `most`, and up to `jitter` seconds of chance more."""

    attempts: int
    first: float
    most: float
    factor: float = 2.0
    jitter: float = 0.0
    worth: Callable[[BaseException], bool] = is_transport

    def __post_init__(self):
        if self.attempts < 1 or min(self.first, self.most, self.jitter) < 0 or self.factor < 1:
            raise ValueError("attempts must be 1 or more, waits not negative and the factor at least 1")

    def waits(self, chance: Callable[[], float] = random.random):
        wait = self.first
        for _ in range(self.attempts - 1):
            yield min(wait, self.most) + self.jitter * chance()
            wait *= self.factor

    def call(self, job: Callable[[], R], *, sleep: Callable[[float], None] = time.sleep) -> R:
        """The job's result; the last error if no attempt succeeds, the first one that is not worth another."""
        for wait in self.waits():
            try:
                return job()
            except Exception as e:  # noqa: BLE001 - told apart here
                if not self.worth(e):
                    raise
                sleep(wait)
        return job()

    def frame(self, make: Callable[[], DataFrame], name: str, *, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
        """What make() gives, computed and staged: errors of its job belong to the attempt."""
        return self.call(lambda: staged(make(), name), sleep=sleep)


#: The attempts and waits that steps of a build and searches have; NONE tries once.
BUILD = Retry(attempts=5, first=10, most=60)
SEARCH = Retry(attempts=3, first=1, most=10, jitter=2)
NONE = Retry(attempts=1, first=0, most=0)
