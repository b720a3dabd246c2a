import pytest
from quay.plans import detect, migrate
from quay.sources import appdb, packages


@pytest.fixture(scope="module")
def db(spark):
    return appdb.pinned(appdb.load(appdb.from_json(spark, appdb.SAMPLE), strict=False))


def text(spark, *files):
    return spark.createDataFrame([(f,) for f in files], "text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parsers(spark):
    desc = spark.createDataFrame([("%NAME%\nfirefox\n\n%VERSION%\n1.2-1\n\n%DESC%\nx\n", "%FILES%\nusr/bin/firefox\nusr/share/applications/firefox.desktop\n"), ("%NAME%\nlib\n", None), ("junk", None)], "text string, files string")
    assert rows(packages.pacman(desc).select("package", "version", "desktop")) == [("firefox", "1.2-1", True), ("lib", None, False)]
    status = "Package: vlc\nStatus: install ok installed\nVersion: 3\nDescription: a\n Version: no\n\nPackage: gone\nStatus: deinstall ok config-files\nVersion: 1\n\nPackage: libfoo\nStatus: install ok installed\n"
    lists = spark.createDataFrame([("vlc.list", "/usr/share/applications/vlc.desktop\n"), ("libfoo:amd64.list", "/usr/lib/x\n")], "file string, text string")
    assert rows(packages.dpkg(text(spark, status), lists).select("package", "desktop")) == [("libfoo", False), ("vlc", True)]
    apk = "P:vlc\nV:3\nF:usr/bin\nR:vlc\nF:usr/share/applications\nR:vlc.desktop\n\nP:lib\nV:1\nF:usr/lib\nR:a.desktop\n"
    assert rows(packages.apk(text(spark, apk)).select("package", "version", "desktop")) == [("lib", "1", False), ("vlc", "3", True)]
    snaps = spark.createDataFrame([(0, "code", "name: code\nversion: '1.93.1'\n"), (0, "core22", None), (0, "gnome-42-2204", None), (1, "other", None)], "ord int, name string, yaml string")
    assert rows(packages.snap(snaps).select("package", "version")) == [("code", "1.93.1")]
    keys = [(0, "Git", "2", None, None, None), (1, "git", "2", None, None, None), (2, "KB123", "1", None, None, None), (3, "Part", "1", 1, None, None), (4, "Fix", "1", None, None, "Hotfix"), (5, " ", "", None, None, None)]
    frame = spark.createDataFrame(keys, "ord int, DisplayName string, DisplayVersion string, SystemComponent int, ParentKeyName string, ReleaseType string")
    assert rows(packages.uninstall_keys(frame).select("name", "version")) == [("Git", "2")]
    assert rows(packages.winget(text(spark, '{"Sources":[{"Packages":[{"PackageIdentifier":"A.B"},{"PackageIdentifier":""}]}]}')).select("package")) == [("A.B",)]
    release = spark.createDataFrame([(0, "# c"), (1, 'ID="pop"'), (2, "ID=ubuntu"), (3, "NAME='x y'")], "n int, text string")
    assert rows(packages.settings(release)) == [("ID", "ubuntu"), ("NAME", "x y")]
    assert rows(packages.user_dirs(spark.createDataFrame([(0, 'XDG_MUSIC_DIR="$HOME/Songs"')], "n int, text string"), "/home/u")) == [("music", "/home/u/Songs")]
    assert packages.family(spark.createDataFrame([(0, "zorin"), (1, "ubuntu")], "pos int, id string")).first().family == "debian"


def test_matching(spark, db):
    seen = [
        ("winget", "quill.heron", None, "heron"), ("apt", "heron-lts", None, "heron"), ("dnf", "heron", None, None), ("pacman", "rook", None, "rook"), ("snap", "warble --classic", None, "warble"),
        ("registry", "", "Heron Browser (x64 de)", "heron"), ("registry", "", "heron browser", "heron"), ("registry", "", "Rook", "rook"), ("registry", "", "Rookery Widget 2.0", None), ("registry", "", "Scribble+ (64-bit)", "scribble-plus"), ("registry", "", "RookHub Bench", None),
    ]
    frame = spark.createDataFrame([(i, v, p, None, n, False) for i, (v, p, n, _) in enumerate(seen)], "seq long, via string, package string, version string, name string, desktop boolean")
    found = detect.match(frame, db)
    assert {r.seq: r.app_id for r in found.collect()} == {i: a for i, (*_, a) in enumerate(seen)}
    assert {r.name for r in detect.unknown(found).where("via = 'registry'").collect()} == {"Rookery Widget 2.0", "RookHub Bench"}


def test_paths(spark):
    cases = [
        ("linux", "", "", "~/.x", "/h/.x"), ("linux", "", "", "$XDG_CONFIG_HOME/a/b", "/cfg/a/b"), ("linux", "flatpak", "org.x", "$XDG_CONFIG_HOME/a", "/h/.var/app/org.x/config/a"), ("linux", "snap", "x", "$XDG_DATA_HOME/a", "/h/snap/x/current/.local/share/a"),
        ("windows", "", "", "%APPDATA%/A", "/h/AppData/Roaming/A"), ("windows", "flatpak", "x", "%APPDATA%/A", None), ("linux", "", "", "/etc/x", None), ("linux", "", "", "~", None), ("linux", "", "", "~/", None),
    ]
    frame = spark.createDataFrame([c[:4] for c in cases], "os string, variant string, sandbox string, path string")
    got = {(r.os, r.variant, r.path): r.abs for r in detect.resolve(frame, home="/h", env={"XDG_CONFIG_HOME": "/cfg"}).collect()}
    assert got == {(o, v, p): a for o, v, _, p, a in cases}


def test_globs(spark):
    entry = '{"id":"x","name":"X","category":"utility","linux":{"apt":["x"]},"config":{"portability":"none","exclude":["cache2","*.lock","storage/default/*/cache","[bad"]}}'
    out = ["cache2/entries/x", "profile.default/cache2", "parent.lock", "storage/default/a/cache"]
    kept = ["prefs.js", "storage/default/a/idb/x", "cache2x/y", "lockfile", "storage/default/a/b/cache"]
    frame = spark.createDataFrame([("x", r) for r in [*out, *kept, "Storage/Default/moz-extension/CACHE"]], "app_id string, rel string")
    got = {r.rel for r in detect.excluded(frame, appdb.normalise(appdb.from_json(spark, [entry]))).where("excluded").collect()}
    assert got == {*out, "Storage/Default/moz-extension/CACHE"}


def test_plan(spark, db):
    manifest = spark.createDataFrame([(0, "heron", "Heron Browser", False), (1, "scribble-plus", "Scribble+", False), (2, "warble", "Warble", False), (3, "rook", "Rook", True), (4, "ghost", "Ghost", False), (5, "kestrel", "Kestrel", False)], "pos long, app_id string, name string, config_only boolean")
    none = spark.createDataFrame([], "seq long, app_id string, via string, package string")
    target = migrate.Target("linux", ["pacman"], none, home="/home/u")
    got = {r.app_id: r for r in migrate.decided(manifest, db, target).collect()}
    assert {a: r.bucket for a, r in got.items()} == {"heron": "install", "scribble-plus": "install", "warble": "no_source", "ghost": "missing", "kestrel": "install"}
    assert got["warble"].needs == ["flatpak", "snap"] and got["ghost"].reason == migrate.NOT_HERE
    install = {r.target_id: r for r in migrate.items(migrate.decided(manifest, db, target), "install").collect()}
    assert install["kestrel"]["for"] == ["scribble-plus"] and set(install) == {"heron", "kestrel"}
    configs = spark.createDataFrame([("heron", 0, "profiles", "", False), ("heron", 1, "profiles", "flatpak", False), ("rook", 0, "rookconfig", "", True), ("scribble-plus", 0, "config", "", False)], "app_id string, ord long, key string, variant string, file boolean")
    placed = {(r.app_id, r.ord): (r.action, r.dest) for r in migrate.config_plan(manifest, configs, db, target, "windows").collect()}
    assert placed == {("heron", 0): ("place", "/home/u/.heron/main"), ("heron", 1): ("aside", None), ("rook", 0): ("aside", None), ("scribble-plus", 0): ("aside", None)}
    roots = migrate.placed_roots(migrate.config_plan(manifest, configs, db, target, "windows"))
    assert rows(roots) == [("apps/heron/profiles", "/home/u/.heron/main")]
    assert rows(detect.by_category(manifest, db))[:2] == [("browser", 1, ["Heron Browser"]), ("editor", 2, ["Kestrel", "Scribble+"])]
    cmds = migrate.commands(migrate.items(migrate.decided(manifest, db, target), "install"), target).collect()
    assert [r.argv for r in cmds] == [["sudo", "pacman", "-Syu", "--needed", "--noconfirm", "heron", "kestrel"]]
    one = spark.createDataFrame([(0, "snap", "code --classic"), (1, "snap", "b"), (2, "apt", "x")], "pos long, manager string, package string")
    lines = [" ".join(r.argv) for r in migrate.commands(one, migrate.Target("linux", ["apt", "snap"], none, elevator="")).orderBy("n").collect()]
    assert lines == ["apt-get update", "apt-get install -y x", "snap install code --classic", "snap install b"]


def test_validation(spark):
    with pytest.raises(ValueError, match="equivalent-unknown"):
        appdb.load(appdb.from_json(spark, [appdb.SAMPLE[2]]))
    assert appdb.load(appdb.from_json(spark, [appdb.SAMPLE[2]]), strict=False).equivalents.count() == 0


def test_json_folder(spark, tmp_path):
    (tmp_path / "lark.json").write_text(appdb.SAMPLE[1])
    (tmp_path / "wrong.json").write_text(appdb.SAMPLE[4].replace('"category"', '"extra":1,"category"'))
    found = appdb.read(spark, str(tmp_path))
    assert rows(appdb.problems(appdb.normalise(found)).select("app_id", "code")) == [("warble", "id-file")]
    assert rows(appdb.unknown_fields(spark, str(tmp_path))) == [("wrong", "extra")]
