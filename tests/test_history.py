"""Method history of a scripted repository against hand counts."""

import subprocess

import pytest

from weftline.operators import evolution as V
from weftline.operators import history as H
from weftline.sources import gitlog

FIRST = "class A {\n  int x;\n  void a() {\n    x = 1;\n  }\n  void b(int i) {\n    x = i;\n  }\n}\n"


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    day = [0]

    def run(*a):
        stamp = f"2020-01-{day[0] + 1:02d}T00:00:00Z"
        env = {"GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp, "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(path)}
        return subprocess.run(["git", "-C", str(path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, env=env).stdout.decode()

    names = {}

    def commit(name, **files):
        day[0] += 1
        for f, text in files.items():
            f = f.replace("_", ".")
            if text is None:
                (path / f).unlink()
            else:
                (path / f).write_bytes(text if isinstance(text, bytes) else text.encode())
        run("add", "-A")
        run("commit", "-q", "-m", name)
        names[name] = run("rev-parse", "HEAD").strip()

    run("init", "-q", "-b", "main")
    commit("root", A_java=FIRST, notes_txt="@@ -1 +1 @@\n")
    commit("body of a", A_java=FIRST.replace("x = 1", "x = 2"))
    commit("field only", A_java=FIRST.replace("x = 1", "x = 2").replace("int x;", "long x;"))
    commit("added", B_java=FIRST.replace("class A", "class B"))
    commit("both", A_java=FIRST.replace("x = 1", "x = 3").replace("x = i", "x = -i"), B_java=FIRST.replace("class A", "class B").replace("x = i", "x = 0"))
    run("checkout", "-q", "-b", "side")
    commit("on the side", A_java=FIRST.replace("x = 1", "x = 3").replace("x = i", "x = -i").replace("void b", "int b"))
    run("checkout", "-q", "main")
    commit("binary", B_java=b"\xff\xfe class", é_java="class É { void ü() { } }\n")
    day[0] += 1
    run("merge", "-q", "--no-ff", "-m", "merge", "side")
    names["merge"] = run("rev-parse", "HEAD").strip()
    commit("gone", A_java=None)
    commit("back to an earlier content", A_java=FIRST, é_java="class É {\n void ü() { }\n}\n")
    return str(path), names


@pytest.mark.parametrize("commits", [500, 1, 3])
def test_log_and_blobs(spark, repository, commits):
    path, names = repository
    rows = gitlog.read_git(spark, [path], commits=commits).collect()
    by = {}
    for r in rows:
        by.setdefault(r.commit_id, {})[r.file] = r
    assert {n: sorted(by.get(sha, {})) for n, sha in names.items()} == {
        "root": ["A.java", "notes.txt"], "body of a": ["A.java"], "field only": ["A.java"], "added": ["B.java"], "both": ["A.java", "B.java"], "on the side": ["A.java"],
        "binary": ["B.java", "é.java"], "merge": ["A.java"], "gone": ["A.java"], "back to an earlier content": ["A.java", "é.java"],
    }
    first, last, gone = by[names["root"]]["A.java"], by[names["back to an earlier content"]]["A.java"], by[names["gone"]]["A.java"]
    assert first.root and not last.root and first.blob == last.blob and first.old_blob is None and last.old_blob is None and gone.blob is None
    assert "+    x = 2;" in by[names["body of a"]]["A.java"].diff
    blobs = {r.blob: r.source for r in gitlog.read_blobs(gitlog.read_git(spark, [path])).collect()}
    assert blobs[first.blob] == FIRST and blobs[by[names["binary"]]["B.java"].blob] is None and "É" in blobs[by[names["binary"]]["é.java"].blob]
    assert len(blobs) == len({r.blob for r in rows if r.blob})


def test_limits(spark, repository):
    path, names = repository
    read = lambda **o: {r.commit_id for r in gitlog.read_git(spark, [path], **o).collect()}
    assert read(newest=1) == {names["back to an earlier content"]}
    assert read(file="B.java") == {names[n] for n in ("added", "both", "binary")}
    assert names["root"] not in read(since="2020-01-03T12:00:00Z") and names["gone"] in read(since="2020-01-03T12:00:00Z")
    assert read(until="2020-01-02T12:00:00Z") == {names["root"]}


def test_method_changes(spark, repository):
    path, names = repository
    log = gitlog.read_git(spark, [path])
    java = log.filter("file like '%.java'")
    lines = H.method_lines(gitlog.read_blobs(java).select("blob", "source"))
    got = {}
    for r in H.method_changes(java, lines).collect():
        got.setdefault((r.commit_id, r.file), set()).add(r.member)
    assert got == {
        (names["root"], "A.java"): {"a()", "b(int)"}, (names["body of a"], "A.java"): {"a()"}, (names["both"], "A.java"): {"a()", "b(int)"}, (names["both"], "B.java"): {"b(int)"},
        (names["on the side"], "A.java"): {"b(int)"}, (names["merge"], "A.java"): {"b(int)"}, (names["back to an earlier content"], "é.java"): {"ü()"},
    }
    few = {(r.commit_id, r.file) for r in H.method_changes(java, lines, 1).collect()}
    assert (names["both"], "A.java") not in few and (names["root"], "A.java") in few
    changes = H.method_changes(java.filter("file = 'A.java'"), lines).select("commit_id", "ts", "member")
    pairs = V.cochange(V.weighted(changes, "2020-02-01 00:00:00")).collect()
    assert [(r.m1, r.m2) for r in pairs] == [("a()", "b(int)")]


def test_a_missing_repository_fails(spark, tmp_path):
    with pytest.raises(Exception, match="git|Git"):
        gitlog.read_git(spark, [str(tmp_path)]).collect()
