"""The HTTP scorer over a stand-in socket; no port is opened."""

import http.client
import io
import json
import os
import pickle
import re
import time

import pytest

from verdictflow.fixed_values import PROMPT
from verdictflow.operators.scorers import HttpScorer
from verdictflow.operators.verdict import verdict_of


class Slow(io.BytesIO):
    def read1(self, size=-1):
        time.sleep(0.02)
        return super().read1(min(size, 7))


class Socket:
    """Keeps what is sent and answers with ``reply``: bytes, an error, or a function of what was sent."""

    def __init__(self, reply, kind):
        self.reply, self.kind, self.sent, self.timeouts, self.closed = reply, kind, b"", [], False
        self.idle, self.hang_up = os.pipe()

    def sendall(self, data):
        if isinstance(self.reply, Exception):
            raise self.reply
        self.sent += data

    def makefile(self, *_):
        return self.kind(self.reply(self.sent) if callable(self.reply) else self.reply)

    def settimeout(self, seconds):
        self.timeouts.append(seconds)

    def fileno(self):
        return self.idle

    def close(self):
        self.closed = True


def http_reply(body, kind="application/json; charset=utf-8", status=200):
    head = f"HTTP/1.1 {status} X\r\nContent-Type: {kind}\r\nContent-Length: {len(body.encode())}\r\n\r\n"
    return head.encode() + body.encode()


@pytest.fixture
def sockets(monkeypatch):
    made = []

    def connect(connection):
        connection.sock = Socket(connect.reply, connect.kind)
        made.append((connection.host, connection.port, connection.sock))

    monkeypatch.setattr(http.client.HTTPConnection, "connect", connect)
    connect.kind = io.BytesIO
    return made, connect


@pytest.fixture
def ask(sockets):
    def ask(reply, *profiles, timeout_s=30.0, kind=io.BytesIO):
        made, connect = sockets
        connect.reply, connect.kind = reply, kind
        scorer = pickle.loads(pickle.dumps(HttpScorer("http://models:11434/api/generate", "m")))
        scorer.open()
        replies = scorer.ask(list(profiles), timeout_s)
        scorer.close()
        return replies

    return ask


ENVELOPE = json.dumps({"response": '{"predicao": 2, "justificativa": "é"}'})


def test_sends_the_prompt_and_returns_the_body(ask, sockets):
    assert [verdict_of(r) for r in ask(http_reply(ENVELOPE), '{"a": "é"}')] == [(2, "é")]
    ((host, port, socket),) = sockets[0]
    assert (host, port, socket.closed) == ("models", 11434, True)
    head, _, body = socket.sent.partition(b"\r\n\r\n")
    assert head.startswith(b"POST /api/generate HTTP/1.1\r\n") and b"Content-Type: application/json" in head
    assert json.loads(body) == {"model": "m", "prompt": PROMPT + '{"a": "é"}', "format": "json", "stream": False}


def test_connection_is_kept(ask, sockets):
    assert [verdict_of(r) for r in ask(http_reply(ENVELOPE), "{}", "{}", "{}")] == [(2, "é")] * 3
    assert len(sockets[0]) == 1


def test_connection_closed_while_idle_is_made_again(sockets):
    made, connect = sockets
    connect.reply = http_reply(ENVELOPE)
    scorer = HttpScorer("http://models:11434/api/generate", None)
    scorer.open()
    assert verdict_of(scorer.ask(["{}"], 30)[0]) == (2, "é")
    os.write(made[0][2].hang_up, b"x")
    assert verdict_of(scorer.ask(["{}"], 30)[0]) == (2, "é")
    assert len(made) == 2 and made[0][2].closed
    assert json.loads(made[1][2].sent.partition(b"\r\n\r\n")[2])["model"] is None


def test_chunked_reply(ask):
    text = ENVELOPE.encode()
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(part), part) for part in (text[:9], text[9:]))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: application/json\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert verdict_of(ask(head + chunks + b"0\r\n\r\n", "{}")[0]) == (2, "é")


def test_status_is_not_looked_at(ask):
    reply = http_reply('{"error": "model not found"}', status=404)
    assert verdict_of(ask(reply, "{}")[0]) == (0, "erro: KeyError - 'response'")


def test_empty_body(ask):
    assert verdict_of(ask(http_reply(""), "{}")[0])[1].startswith("erro: TypeError - ")


def test_body_not_declared_as_json(ask):
    reply = http_reply("<html>", "text/html", 502)
    assert verdict_of(ask(reply, "{}")[0])[1] == (
        "erro: ContentTypeError - 502, message='Attempt to decode JSON with unexpected mimetype: text/html', "
        "url='http://models:11434/api/generate'"
    )


@pytest.mark.parametrize(
    ("error", "reason"),
    [
        (ConnectionRefusedError(111, "refused"), "erro: ConnectionRefusedError - [Errno 111] refused"),
        (TimeoutError("timed out"), "erro: TimeoutError - "),
    ],
)
def test_errors_become_rows_and_the_next_call_connects_again(ask, sockets, error, reason):
    assert [verdict_of(r) for r in ask(error, "{}", "{}")] == [(0, reason)] * 2
    assert len(sockets[0]) == 2


def test_server_that_hangs_up(ask):
    assert verdict_of(ask(b"", "{}")[0])[1].startswith("erro: RemoteDisconnected - ")


def test_timeout_covers_the_whole_reply(ask, sockets):
    begin = time.monotonic()
    replies = ask(http_reply("x" * 700), "{}", timeout_s=0.1, kind=Slow)
    assert verdict_of(replies[0]) == (0, "erro: TimeoutError - ")
    assert time.monotonic() - begin < 1
    left = sockets[0][0][2].timeouts
    assert left == sorted(left, reverse=True) and max(left) <= 0.1


def asked(sockets, url, reply):
    made, connect = sockets
    connect.reply = reply
    scorer = HttpScorer(url, "m")
    scorer.open()
    (answer,) = scorer.ask(["{}"], 30.0)
    scorer.close()
    lines = [line for _, _, s in made for line in re.findall("(?:POST|GET) \\S+ HTTP/1.1", s.sent.decode())]
    return answer, lines, [(host, port) for host, port, _ in made]


def test_query_string_is_sent(sockets):
    answer, lines, _ = asked(sockets, "http://models?api-version=1", http_reply(ENVELOPE))
    assert answer == ENVELOPE and lines == ["POST /?api-version=1 HTTP/1.1"]


def redirect(status, target):
    return http_reply("", status=status).replace(b"X\r\n", b"X\r\nLocation: " + target.encode() + b"\r\n", 1)


@pytest.mark.parametrize("status, method", [(307, "POST"), (308, "POST"), (301, "GET"), (302, "GET"), (303, "GET")])
def test_redirects_are_followed(sockets, status, method):
    reply = lambda sent: http_reply(ENVELOPE) if b" /new?x=1 " in sent else redirect(status, "/new?x=1")
    answer, lines, servers = asked(sockets, "http://models:11434/old", reply)
    assert answer == ENVELOPE and lines == ["POST /old HTTP/1.1", f"{method} /new?x=1 HTTP/1.1"]
    assert servers == [("models", 11434)]


def test_redirects_to_another_server_and_without_end(sockets):
    reply = lambda sent: http_reply(ENVELOPE) if b"Host: other:81" in sent else redirect(307, "http://other:81/a")
    answer, _, servers = asked(sockets, "http://models:80/a", reply)
    assert answer == ENVELOPE and servers == [("models", 80), ("other", 81)]
    answer, lines, _ = asked(sockets, "http://models:82/a", redirect(307, "/a"))
    assert verdict_of(answer)[1].startswith("erro: TooManyRedirects - 307") and sum("/a" in x for x in lines) >= 11


def test_a_redirect_status_without_a_place_is_an_answer(sockets):
    assert asked(sockets, "http://models/", http_reply(ENVELOPE, status=302))[0] == ENVELOPE
