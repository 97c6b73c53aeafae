"""Models behind plans: captions of clips, embeddings of pictures and text."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import mimetypes
import os
import tempfile
import time
import urllib.error
import urllib.request
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import snapshot


class CaptionBackend(ABC):
    """Describes clips and pictures; what goes wrong is raised and becomes a row.

    What an error says when another try may do, how many tries there are, and the seconds
    before the second one (before the third it is twice that, and so on).
    """

    transient: tuple[str, ...] = ("429", "quota", "rate", "503", "overloaded", "timeout")
    tries, wait = 5, 45.0

    @abstractmethod
    def caption_video(self, path: str, prompt: str) -> str: ...

    @abstractmethod
    def caption_image(self, path: str, prompt: str) -> str: ...


class EmbeddingBackend(ABC):
    @abstractmethod
    def images(self, paths: list[str]) -> np.ndarray: ...

    @abstractmethod
    def texts(self, texts: list[str]) -> np.ndarray: ...


class SceneDetector(ABC):
    """Scores of change between frames; what goes wrong is raised and becomes a row."""

    @abstractmethod
    def scores(self, path: str) -> tuple[float, list[tuple[int, float]]]:
        """Frames a second, and (frame, score) of every frame that has a score."""


class EchoCaptions(CaptionBackend):
    """Says the name of the file and the prompt's length: the same for the same input. For tests."""

    def caption_video(self, path: str, prompt: str) -> str:
        return f"{path.rsplit('/', 1)[-1]} moves from left to right and then fades ({len(prompt)})"

    def caption_image(self, path: str, prompt: str) -> str:
        return f"{path.rsplit('/', 1)[-1]} in the foreground ({len(prompt)})"


class HashEmbeddings(EmbeddingBackend):
    """Unit vectors drawn from a digest: the same for the same input. They say nothing of
    what is in a picture; for tests."""

    def __init__(self, width: int = 64):
        self.width = width

    def _of(self, keys: list[str]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.sha256(k.encode()).digest()[:8])).normal(size=self.width) for k in keys]
        out = np.array(rows, np.float32).reshape(len(keys), self.width)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def images(self, paths: list[str]) -> np.ndarray:
        return self._of(paths)

    def texts(self, texts: list[str]) -> np.ndarray:
        return self._of(texts)


#: Kinds of files by suffix, where the system's table may lack them.
KINDS = {".mp4": "video/mp4", ".mov": "video/quicktime", ".mkv": "video/x-matroska", ".avi": "video/x-msvideo", ".webm": "video/webm", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif"}


def kind_of(path: str) -> str:
    return KINDS.get(os.path.splitext(path)[1].lower()) or mimetypes.guess_type(path)[0] or "application/octet-stream"


def data_uri(path: str) -> str:
    with open(path, "rb") as f:
        return f"data:{kind_of(path)};base64,{base64.b64encode(f.read()).decode()}"


def fetch(url: str, headers: dict[str, str], body: dict | None = None, seconds: float = 120) -> dict:
    """The JSON that a service answers; its refusal of an input (422) is a ValueError, any
    other an OSError that begins with the status."""
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=seconds) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        said = f"{e.code}: {e.read(300).decode('utf-8', 'replace')}"
        raise (ValueError if e.code == 422 else OSError)(said) from None


class ChatCaptions(CaptionBackend):
    """A chat endpoint that takes pictures. A clip is sent as frames, `fps` a second."""

    def __init__(self, url: str = "http://localhost:11434/v1", model: str = "llama3.2-vision", key: str | None = None, seconds: float = 120, fps: int = 1, runner: Callable[[list[str], float], None] | None = None):
        self.url, self.model, self.key, self.seconds, self.fps = url.rstrip("/"), model, key or "none", seconds, fps
        self.runner = runner

    def ask(self, pictures: list[str], prompt: str) -> str:
        content = [{"type": "image_url", "image_url": {"url": data_uri(p)}} for p in pictures] + [{"type": "text", "text": prompt}]
        reply = fetch(f"{self.url}/chat/completions", {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "messages": [{"role": "user", "content": content}]}, self.seconds)
        if not (choices := reply.get("choices")):
            raise ValueError(f"no answer in {str(reply)[:300]}")
        return (choices[0].get("message", {}).get("content") or "").strip()

    def caption_image(self, path: str, prompt: str) -> str:
        return self.ask([path], prompt)

    def caption_video(self, path: str, prompt: str) -> str:
        from .operators.media import tool

        with tempfile.TemporaryDirectory() as d:  # of this task alone
            (self.runner or tool)(["ffmpeg", "-y", "-i", path, "-vf", f"fps={self.fps}", "-q:v", "2", os.path.join(d, "%06d.jpg")], self.seconds)
            frames = sorted(os.path.join(d, f) for f in os.listdir(d))
            if not frames:
                raise ValueError("no frame was made")
            return self.ask(frames, f"These {len(frames)} pictures are one clip, {self.fps} for each second. Describe the clip as a whole, not its pictures.\n\n{prompt}")


class PredictionCaptions(CaptionBackend):
    """A service of hosted models that takes files as data URIs and waits for the answer.
    Which input a model takes them by is read from its schema once."""

    transient, tries, wait = ("timeout", "503", "rate", "429"), 3, 15.0

    def __init__(self, model: str = "google/gemini-2.5-flash", key: str | None = None, seconds: float = 120, url: str = "https://api.replicate.com/v1/models"):
        if not (key := key or os.environ.get("REPLICATE_API_TOKEN", "")):
            raise ValueError("set REPLICATE_API_TOKEN")
        self.url, self.seconds, self.inputs = f"{url.rstrip('/')}/{model}", seconds, None
        self.headers = {"Authorization": f"Bearer {key}", "Prefer": "wait"}

    def known(self) -> set[str]:
        if self.inputs is None:
            try:
                version = fetch(self.url, self.headers, seconds=30).get("latest_version") or {}
                made = version if "openapi_schema" in version else fetch(f"{self.url}/versions/{version['id']}", self.headers, seconds=30)
                self.inputs = set(made["openapi_schema"]["components"]["schemas"]["Input"]["properties"])
            except (OSError, ValueError, KeyError, TypeError):
                self.inputs = set()
        return self.inputs

    def ask(self, path: str, prompt: str, kind: str) -> str:
        uri, names = data_uri(path), self.known()
        name = next((n for n in (f"{kind}s", kind, "media") if n in names), f"{kind}s")
        reply = fetch(f"{self.url}/predictions", self.headers, {"input": {"prompt": prompt, name: [uri] if name.endswith("s") else uri}}, self.seconds)
        if reply.get("status") == "failed":
            raise OSError(f"the prediction failed: {reply.get('error')}")
        out = reply.get("output") or ""
        return ("".join(map(str, out)) if isinstance(out, list) else str(out)).strip()

    def caption_video(self, path: str, prompt: str) -> str:
        return self.ask(path, prompt, "video")

    def caption_image(self, path: str, prompt: str) -> str:
        return self.ask(path, prompt, "image")


class GenaiCaptions(CaptionBackend):
    """The google-genai client: pictures go with the request; clips are uploaded, waited
    for and deleted again. Needs google-genai, unless a client is given."""

    transient, tries, wait = ("429", "quota", "rate", "503", "overloaded"), 5, 45.0

    def __init__(self, model: str = "gemini-2.5-flash", key: str | None = None, poll: float = 2.0, client=None, part: Callable | None = None):
        if client is None:
            if not (key := key or os.environ.get("GEMINI_API_KEY", "")):
                raise ValueError("set GEMINI_API_KEY")
            from google import genai
            from google.genai import types

            client, part = genai.Client(api_key=key), types.Part.from_bytes
        self.client, self.model, self.poll, self.part = client, model, poll, part

    def ask(self, *contents) -> str:
        return (self.client.models.generate_content(model=self.model, contents=list(contents)).text or "").strip()

    def caption_image(self, path: str, prompt: str) -> str:
        with open(path, "rb") as f:
            return self.ask(self.part(data=f.read(), mime_type=kind_of(path)), prompt)

    def caption_video(self, path: str, prompt: str) -> str:
        name = os.path.basename(path).encode("ascii", "replace").decode()  # names beyond ASCII break uploads
        with open(path, "rb") as f:
            held = self.client.files.upload(file=f, config={"mime_type": kind_of(path), "display_name": name})
        try:
            while held.state.name == "PROCESSING":
                time.sleep(self.poll)
                held = self.client.files.get(name=held.name)
            if held.state.name != "ACTIVE":
                raise ValueError(f"the upload ended as {held.state.name}")
            return self.ask(held, prompt)
        finally:
            with contextlib.suppress(Exception):  # a file that stays does no harm
                self.client.files.delete(name=held.name)


def clip(model: str = "openai/clip-vit-base-patch32") -> EmbeddingBackend:
    """CLIP's embeddings of pictures and text, as unit vectors. Needs transformers, torch
    and pillow."""
    import torch
    from PIL import Image
    from transformers import CLIPModel, CLIPProcessor

    net, prepare = CLIPModel.from_pretrained(model).eval(), CLIPProcessor.from_pretrained(model)

    def unit(x) -> np.ndarray:
        return (x / x.norm(dim=-1, keepdim=True)).numpy().astype(np.float32)

    class Clip(EmbeddingBackend):
        def images(self, paths: list[str]) -> np.ndarray:
            with torch.no_grad():
                return unit(net.get_image_features(**prepare(images=[Image.open(p).convert("RGB") for p in paths], return_tensors="pt")))

        def texts(self, texts: list[str]) -> np.ndarray:
            with torch.no_grad():
                return unit(net.get_text_features(**prepare(text=texts, return_tensors="pt", padding=True, truncation=True)))

    return Clip()


#: Embeddings that a command can be told to use.
EMBEDDINGS: dict[str, Callable[[], EmbeddingBackend]] = {"clip": clip}


def embeddings(name: str) -> Callable[[], EmbeddingBackend]:
    if name not in EMBEDDINGS:
        raise ValueError(f"no embeddings {name}; there are {', '.join(sorted(EMBEDDINGS))}")
    return EMBEDDINGS[name]


#: Services that a command can be told to use. EchoCaptions is for tests.
BACKENDS: dict[str, Callable[..., CaptionBackend]] = {"gemini": GenaiCaptions, "replicate": PredictionCaptions, "openai": ChatCaptions}


def register(name: str) -> Callable:
    def add(make):
        BACKENDS[name] = make
        return make

    return add


def backend(name: str, **settings) -> CaptionBackend:
    if name not in BACKENDS:
        raise ValueError(f"no backend {name}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name](**settings)


def pyscenedetect() -> SceneDetector:
    """PySceneDetect's content values. Needs scenedetect."""
    from scenedetect import ContentDetector, SceneManager, StatsManager, open_video

    class Detector(SceneDetector):
        def scores(self, path: str) -> tuple[float, list[tuple[int, float]]]:
            video, stats = open_video(path), StatsManager()
            manager = SceneManager(stats_manager=stats)
            manager.add_detector(ContentDetector())
            n = manager.detect_scenes(video)
            found = ((k, stats.get_metrics(k, ["content_val"])[0]) for k in range(n + 1) if stats.metrics_exist(k, ["content_val"]))
            return float(video.frame_rate), [(k, float(v)) for k, v in found if v is not None]

    return Detector()


DETECTORS: dict[str, Callable[[], SceneDetector]] = {"pyscenedetect": pyscenedetect}


def detector(name: str) -> Callable[[], SceneDetector]:
    if name not in DETECTORS:
        raise ValueError(f"no scene detector {name}; there are {', '.join(sorted(DETECTORS))}")
    return DETECTORS[name]


def change_scores(videos: DataFrame, make: Callable[[], SceneDetector], least: float = 0.0) -> DataFrame:
    """path, fps, frames (array of frame, score of at least `least`), error for videos
    (path). A detector that isn't installed is an error in every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    model = model or make()
                    fps, scores = model.scores(path)
                    if not fps > 0:
                        raise ValueError("no frame rate")
                    out.append((path, fps, [{"frame": k, "score": v} for k, v in scores if v >= least], None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "fps", "frames", "error"])

    return videos.select("path").mapInPandas(run, "path string, fps double, frames array<struct<frame:bigint,score:double>>, error string")


def with_retries(call: Callable[[], str], tries: int = 5, wait: float = 45.0, sleep: Callable[[float], None] = time.sleep, transient: tuple[str, ...] = CaptionBackend.transient) -> str:
    for k in range(1, tries + 1):
        try:
            return call()
        except Exception as e:
            if k == tries or isinstance(e, ValueError) or not any(t in str(e).lower() for t in transient):
                raise
            sleep(wait * k)
    raise AssertionError


class Turns:
    """Calls of `tasks` tasks at least `seconds` apart, on one schedule: of each round of turns
    the task of number k takes the k-th. A task that is late goes on from there and makes
    nothing up, so the rate holds on the whole; its late call may fall beside another task's turn."""

    def __init__(self, seconds: float, tasks: int, k: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.clock, self.sleep, self.round = clock, sleep, seconds * tasks
        self.next = clock() + seconds * k

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(self.next, now) + self.round


class Answers:
    """The answers of one part of a run's clips: lines of a file that each attempt at it adds to as
    they come, so a task that runs again finds those that were paid for. A line counts if it's whole."""

    def __init__(self, folder: str, run: str, part: int):
        self.folder, self.part = os.path.join(folder, run), f"part-{part:06d}-"
        os.makedirs(self.folder, exist_ok=True)
        self.held: dict[str, tuple[str, float]] = {}
        for name in sorted(os.listdir(self.folder)):
            if name.startswith(self.part):
                with open(os.path.join(self.folder, name), encoding="utf-8", errors="replace") as f:
                    for line in f:
                        with contextlib.suppress(ValueError, KeyError, TypeError):
                            one = json.loads(line)
                            if one["whole"]:
                                self.held[one["key"]] = (one["caption"], one["seconds"])
        self.file = None

    def add(self, key: str, text: str, seconds: float) -> None:
        if self.file is None:
            self.file = open(os.path.join(self.folder, f"{self.part}{uuid.uuid4().hex}.jsonl"), "a", encoding="utf-8")  # noqa: SIM115
        self.file.write(json.dumps({"key": key, "caption": text, "seconds": seconds, "whole": True}) + "\n")
        self.file.flush()
        os.fsync(self.file.fileno())
        self.held[key] = (text, seconds)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def answered(spark: SparkSession, log: str) -> DataFrame:
    """key, caption, seconds of all runs of a log; lines that a lost task left unfinished don't count."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    kinds = "key string, caption string, seconds double, whole boolean"
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], kinds).drop("whole")
    rows = spark.read.schema(kinds).option("recursiveFileLookup", "true").json(log)
    return rows.where("whole and key is not null and caption is not null").drop("whole").dropDuplicates(["key"])


CAPTIONED = "path string, caption string, success boolean, error string, seconds double"


def caption(clips: DataFrame, make: Callable[[], CaptionBackend], delay: float = 0.0, tries: int | None = None, wait: float | None = None, log: str | None = None, rate: float | None = None, again: bool = False) -> DataFrame:
    """path, caption, success, error, seconds for clips (path, prompt, is_video). One clip
    that fails doesn't end the others; a backend that can't be made is an error in every
    row.

    rate: calls a minute of all tasks together, tries included; clips are dealt by path to as
    many tasks as run at once, which take turns. Without it the number of partitions
    bounds the rate.
    log: a folder that all tasks reach, for one service. An answer is written there before
    the next call. A clip that an earlier run has, with its prompt, size and time, isn't asked for
    (unless again), nor is one that an earlier attempt at its task or an earlier reading of the
    same result has; failures are asked for again. Clips without a path are never in a log.
    """
    spark, run_id = clips.sparkSession, f"run-{uuid.uuid4().hex}"
    rows, known = clips.select("path", "prompt", "is_video"), None
    if log is not None:
        now = snapshot.stamped(rows)
        key = F.sha2(F.to_json(F.struct("path", "prompt", "is_video", *snapshot.STAMP)), 256)
        rows = rows.join(now, "path", "left").select("path", "prompt", "is_video", F.when(F.col("path").isNotNull(), key).alias("key"))
        if not again:
            before = answered(spark, log)
            known = rows.join(before, "key").select("path", "caption", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), "seconds")
            rows = rows.join(before.select("key"), "key", "left_anti").select("path", "prompt", "is_video", "key")
    else:
        rows = rows.withColumn("key", F.lit(None).cast("string"))
    tasks = spark.sparkContext.defaultParallelism
    if log is not None or rate:
        # By path, so that a task that runs again, in this plan or another, has the same clips.
        rows = rows.repartition(tasks, "path")
    rows = rows.withColumn("part", F.pmod(F.hash("path"), F.lit(tasks)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, logs = None, {}
        turns = Turns(60.0 / rate, tasks, TaskContext.get().partitionId() % tasks) if rate else None
        with contextlib.ExitStack() as stack:

            def answers_of(part: int) -> Answers | None:
                if log is not None and part not in logs:
                    logs[part] = stack.enter_context(contextlib.closing(Answers(log, run_id, part)))
                return logs.get(part)

            def asked(f: Callable[[str, str], str], path: str, prompt: str) -> str:
                if turns:
                    turns.wait()
                return f(path, prompt)

            for batch in batches:
                out = []
                for path, prompt, video, key, part in zip(*(batch[c] for c in ("path", "prompt", "is_video", "key", "part")), strict=True):
                    answers = answers_of(part)
                    if answers and key in answers.held:
                        text, seconds = answers.held[key]
                        out.append((path, text, True, None, seconds))
                        continue
                    began = time.monotonic()
                    try:
                        model = model or make()
                        f = model.caption_video if video else model.caption_image
                        text = with_retries(lambda f=f, p=path, q=prompt: asked(f, p, q), tries or model.tries, model.wait if wait is None else wait, transient=model.transient)
                    except Exception as e:  # noqa: BLE001
                        out.append((path, None, False, str(e) or type(e).__name__, time.monotonic() - began))
                        continue
                    seconds = time.monotonic() - began
                    if answers and key is not None:
                        answers.add(key, text, seconds)
                    out.append((path, text, True, None, seconds))
                    time.sleep(delay)
                yield pd.DataFrame(out, columns=["path", "caption", "success", "error", "seconds"])

    made = rows.mapInPandas(run, CAPTIONED)
    return made if known is None else made.unionByName(known)


def embed(items: DataFrame, make: Callable[[], EmbeddingBackend], column: str, kind: str = "images") -> DataFrame:
    """items with the embedding of a column of paths or texts; the model is made once in
    each task and called for whole batches."""
    kinds = ", ".join(f"`{c}` {k}" for c, k in items.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            vectors = getattr(model, kind)(batch[column].tolist())
            yield batch.assign(embedding=list(vectors))

    return items.mapInPandas(run, f"{kinds}, embedding array<float>")


def embed_or_say(items: DataFrame, make: Callable[[], EmbeddingBackend], column: str, kind: str = "images") -> DataFrame:
    """embed() with a column error: an item that fails, or every one if the model can't
    be made, has that instead of an embedding. A batch that fails is tried item by item."""
    items = items.drop("error")
    kinds = ", ".join(f"`{c}` {k}" for c, k in items.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, missing = None, None
        try:
            model = make()
        except Exception as e:  # noqa: BLE001
            missing = str(e) or type(e).__name__
        for batch in batches:
            keys, vectors, errors = batch[column].tolist(), [None] * len(batch), [missing] * len(batch)
            if model is not None:
                of = getattr(model, kind)
                try:
                    vectors = list(of(keys))
                except Exception:  # noqa: BLE001
                    for i, k in enumerate(keys):
                        try:
                            vectors[i] = of([k])[0]
                        except Exception as e:  # noqa: BLE001
                            errors[i] = str(e) or type(e).__name__
            yield batch.assign(embedding=vectors, error=errors)

    return items.mapInPandas(run, f"{kinds}, embedding array<float>, error string")
