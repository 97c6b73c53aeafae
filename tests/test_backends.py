"""Caption services against a server and a client of our own, and what commands write."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace

import pytest

from cinesift import backends, cli, prompts
from cinesift.lineage import materialize
from cinesift.plans import commands


@pytest.fixture
def server():
    seen, answers = [], {}

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")
            seen.append((self.path, body, dict(self.headers)))
            status, reply = answers[self.path]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        do_GET = do_POST = answer

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", seen, answers
    made.shutdown()


def test_chat_sends_a_clip_as_frames(server, tmp_path):
    url, seen, answers = server
    answers["/v1/chat/completions"] = (200, {"choices": [{"message": {"content": " she turns \n"}}]})

    def runner(command, seconds):
        assert command[:4] == ["ffmpeg", "-y", "-i", "clip.mp4"] and "fps=2" in command
        for k in (1, 2, 3):
            with open(command[-1].replace("%06d", f"{k:06d}"), "wb") as f:
                f.write(b"frame")

    made = backends.ChatCaptions(f"{url}/v1/", "m", fps=2, runner=runner)
    assert made.caption_video("clip.mp4", "Describe.") == "she turns"
    content = seen[0][1]["messages"][0]["content"]
    assert [c["type"] for c in content] == ["image_url"] * 3 + ["text"]
    assert content[0]["image_url"]["url"].startswith("data:image/jpeg;base64,") and content[-1]["text"].endswith("Describe.")
    (tmp_path / "a.png").write_bytes(b"x")
    assert made.caption_image(str(tmp_path / "a.png"), "p") == "she turns"
    answers["/v1/chat/completions"] = (503, {"error": "later"})
    with pytest.raises(OSError, match="503"):
        made.caption_image(str(tmp_path / "a.png"), "p")
    with pytest.raises(ValueError, match="no frame"):
        backends.ChatCaptions(url, runner=lambda c, s: None).caption_video("clip.mp4", "p")


@pytest.mark.parametrize(("names", "field", "as_list"), [(["videos", "images"], "videos", True), (["video"], "video", False), (["media"], "media", False), (None, "videos", True)])
def test_predictions_use_the_models_own_input(server, tmp_path, names, field, as_list):
    url, seen, answers = server
    schema = {"openapi_schema": {"components": {"schemas": {"Input": {"properties": {n: {} for n in names or []}}}}}}
    answers["/o/m"] = (200, {"latest_version": {"id": "v1"}}) if names else (404, {})
    answers["/o/m/versions/v1"] = (200, schema)
    answers["/o/m/predictions"] = (201, {"status": "succeeded", "output": ["a ", "clip "]})
    (tmp_path / "a.mov").write_bytes(b"x")
    made = backends.PredictionCaptions("o/m", "key", url=url)
    assert made.caption_video(str(tmp_path / "a.mov"), "p") == "a clip"
    sent = seen[-1][1]["input"]
    assert set(sent) == {"prompt", field} and isinstance(sent[field], list) == as_list and seen[-1][2]["Prefer"] == "wait"
    answers["/o/m/predictions"] = (422, {"detail": "rate"})
    with pytest.raises(ValueError):  # not tried again, though it says rate
        backends.with_retries(lambda: made.caption_video(str(tmp_path / "a.mov"), "p"), sleep=lambda s: pytest.fail("slept"))


def test_uploads_are_waited_for_and_deleted(tmp_path):
    (tmp_path / "ü.mp4").write_bytes(b"x")
    states, calls = ["PROCESSING", "ACTIVE"], []
    held = lambda s: SimpleNamespace(name="f1", state=SimpleNamespace(name=s))
    files = SimpleNamespace(upload=lambda file, config: calls.append(config) or held("PROCESSING"), get=lambda name: held(states.pop(0)), delete=lambda name: calls.append(name))
    client = SimpleNamespace(files=files, models=SimpleNamespace(generate_content=lambda model, contents: SimpleNamespace(text=f" {len(contents)} ")))
    made = backends.GenaiCaptions(client=client, part=lambda data, mime_type: mime_type, poll=0)
    assert made.caption_video(str(tmp_path / "ü.mp4"), "p") == "2"
    assert calls == [{"mime_type": "video/mp4", "display_name": "?.mp4"}, "f1"]
    states[:] = ["FAILED"]
    with pytest.raises(ValueError, match="FAILED"):
        made.caption_video(str(tmp_path / "ü.mp4"), "p")
    assert calls[-1] == "f1"


def test_captions_and_audits_are_written(spark, tmp_path):
    for f in ("a.mp4", "b.c.mp4", "d.mp4", "d.txt"):
        (tmp_path / f).write_text("She stands by a door" if f.endswith("txt") else "")
    done = materialize(commands.caption(spark, str(tmp_path), backends.EchoCaptions), "captions")
    assert sorted(r.output.rsplit("/", 1)[-1] for r in commands.caption_files(done).collect()) == ["a.txt", "b.c.txt"]
    assert (tmp_path / "b.c.txt").read_text().startswith("b.c.mp4 moves") and (tmp_path / "d.txt").read_text() == "She stands by a door"
    checked = materialize(commands.audit(spark, str(tmp_path), backends.EchoCaptions), "audit")
    assert {r.path.rsplit("/", 1)[-1]: r.recommendation for r in checked.collect()} == {"a.mp4": "keep", "b.c.mp4": "keep", "d.mp4": "review"}
    assert all(r.success for r in commands.caption_files(checked, ".audit.txt").collect())
    assert (tmp_path / "d.audit.txt").exists() and not list(tmp_path.glob("*.part"))


def test_a_missing_service_is_an_error_in_every_row(spark, tmp_path, monkeypatch, capsys):
    for key in ("GEMINI_API_KEY", "REPLICATE_API_TOKEN"):
        monkeypatch.delenv(key, raising=False)
    (tmp_path / "a.mp4").write_text("")
    (tmp_path / "b.txt").write_text("x")
    assert cli.main(["caption", str(tmp_path), "--delay", "0"]) == 1
    assert "GEMINI_API_KEY" in capsys.readouterr().out and not (tmp_path / "a.txt").exists()
    with pytest.raises(SystemExit):
        cli.main(["caption", str(tmp_path), "--provider", "echo"])


def test_prompts(spark):
    one = lambda *a, **k: spark.range(1).select(prompts.build(*a, **k)).first()[0]
    assert one("style", anchor="Luna", custom="Own words") == "Own words"
    assert one("character", anchor="Luna", tags=("vintage", "retro")).endswith('"vintage", "retro".') and "{" not in one("character", anchor="Luna")
    assert "Luna" in one("character", anchor="Luna") and one(None) != one("motion")
