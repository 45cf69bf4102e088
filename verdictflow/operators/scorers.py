"""Scorers: what answers a profile with a reply envelope."""

from __future__ import annotations

import http.client
import json
import select
import threading
import time
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit

from verdictflow.fixed_values import LOAN_PURPOSE, PROMPT


class Scorer:
    """Answers profiles. Pickled to the workers, opened and closed once per task.

    A subclass gives ``answer``, from a profile to the text of the reply envelope;
    what it raises takes the reply's place. One that answers many at once gives
    ``ask`` instead, which gets up to ``batch_size`` profiles and returns as many
    replies or exceptions. Both run on several threads when more than one call may
    be in flight, and have to give up on their own after ``timeout_s``.
    """

    batch_size = 1

    def open(self) -> None:
        pass

    def close(self) -> None:
        pass

    def answer(self, profile: str, timeout_s: float) -> str:
        raise NotImplementedError

    def ask(self, profiles: list[str], timeout_s: float) -> list[str | Exception]:
        replies: list[str | Exception] = []
        for profile in profiles:
            try:
                replies.append(self.answer(profile, timeout_s))
            except Exception as error:
                replies.append(error)
        return replies


class FunctionScorer(Scorer):
    """A function from one profile to one envelope."""

    def __init__(self, function: Callable[[str], str]):
        self.function = function

    def answer(self, profile: str, timeout_s: float) -> str:
        return self.function(profile)


class RubricScorer(Scorer):
    """Offline stand-in for a model: points for the four factors of the prompt.

    The prompt ranks the factors and gives no thresholds; these are our own, and
    agree with its two worked examples. A purpose that is still a code gets no
    verdict.
    """

    batch_size = 512

    risky_accounts = ("< 0 DM (Saldo Negativo)", "Sem conta corrente")
    risky_histories = ("Atrasos passados", "Conta crítica / Outros bancos")
    productive_purposes = ("Educação", "Negócios")
    high_amount, long_months, risk_limit = 5000, 24, 4

    def open(self) -> None:
        self.replies = [self._reply(points) for points in range(8)]
        self.labels = frozenset(LOAN_PURPOSE.values())

    def answer(self, profile: str, timeout_s: float) -> str:
        fields = json.loads(profile)
        purpose = fields["proposito_emprestimo"]
        if purpose not in self.labels:
            return json.dumps({"response": json.dumps({"justificativa": f"Propósito {purpose}?"})})
        points = 3 * (fields["status_conta_corrente"] in self.risky_accounts)
        points += 2 * (fields["historico_credito"] in self.risky_histories)
        points += (
            fields["valor_credito_solicitado"] >= self.high_amount
            and fields["duracao_credito_meses"] >= self.long_months
        )
        points += points > 0 and purpose not in self.productive_purposes
        return self.replies[points]

    def _reply(self, points: int) -> str:
        risky = points >= self.risk_limit
        reason = f"Risco {'alto' if risky else 'baixo'}: {points} de 7 pontos."
        answer = json.dumps({"predicao": 2 if risky else 1, "justificativa": reason})
        return json.dumps({"response": answer})


class ContentTypeError(Exception):
    """The server answered with something not declared as JSON."""


class TooManyRedirects(Exception):
    """The server sent the request on more than ten times."""


class HttpScorer(Scorer):
    """Posts each prompt to a generate endpoint and returns the reply body.

    The timeout covers the whole exchange, the status is not looked at but for
    redirects, which are followed, and nothing is retried. Each thread keeps one
    connection per server for its task's lifetime.
    """

    max_redirects = 10

    def __init__(self, url: str, model_name: str | None):
        self.url, self.model_name = url, model_name

    def open(self) -> None:
        self._own, self._all = threading.local(), []

    def close(self) -> None:
        for connection in self._all:
            connection.close()

    def __getstate__(self) -> dict:
        return {"url": self.url, "model_name": self.model_name}

    def answer(self, profile: str, timeout_s: float) -> str:
        try:
            return self._post(profile, time.monotonic() + timeout_s)
        except TimeoutError:
            raise TimeoutError from None  # wherever the time ran out, without a text

    def _post(self, profile: str, deadline: float) -> str:
        request = {"model": self.model_name, "prompt": PROMPT + profile, "format": "json", "stream": False}
        method, url, text = "POST", self.url, json.dumps(request)
        for _ in range(self.max_redirects + 1):
            response, body = self._exchange(method, url, text, deadline)
            target = response.headers.get("Location") if response.status in (301, 302, 303, 307, 308) else None
            if target is None:
                break
            url = urljoin(url, target)
            if response.status in (301, 302, 303):  # as browsers do: the answer is fetched, not posted for
                method, text = "GET", None
        else:
            raise TooManyRedirects(f"{response.status}, url={self.url!r}")
        mime = response.headers.get_content_type()
        if not (mime == "application/json" or mime.endswith("+json")):
            problem = f"Attempt to decode JSON with unexpected mimetype: {mime}"
            raise ContentTypeError(f"{response.status}, message={problem!r}, url={self.url!r}")
        return body.decode(response.headers.get_content_charset("utf-8")).strip() or "null"

    def _exchange(self, method: str, url: str, text: str | None, deadline: float) -> tuple[http.client.HTTPResponse, bytes]:
        connection, address = self._connection(url, deadline), urlsplit(url)
        place = (address.path or "/") + (f"?{address.query}" if address.query else "")
        try:
            connection.request(method, place, text, {"Content-Type": "application/json"} if text else {})
            self._limit(connection, deadline)
            response = connection.getresponse()
            body = b""
            while part := response.read1(65536):
                body += part
                self._limit(connection, deadline)
            response.close()
        except BaseException:
            connection.close()
            raise
        return response, body

    def _connection(self, url: str, deadline: float) -> http.client.HTTPConnection:
        address = urlsplit(url)
        server = address.scheme, address.hostname, address.port
        own = self._own.__dict__.setdefault("connections", {})
        connection = own.get(server)
        if connection is None:
            kind = http.client.HTTPSConnection if address.scheme == "https" else http.client.HTTPConnection
            connection = own[server] = kind(address.hostname, address.port)
            self._all.append(connection)
        elif connection.sock is not None and select.select([connection.sock], [], [], 0)[0]:
            connection.close()  # the server hung up while it was idle
        self._limit(connection, deadline)
        return connection

    @staticmethod
    def _limit(connection: http.client.HTTPConnection, deadline: float) -> None:
        left = deadline - time.monotonic()
        if left <= 0:
            raise TimeoutError
        connection.timeout = left
        if connection.sock is not None:
            connection.sock.settimeout(left)
