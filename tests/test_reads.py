"""Text is read and parsed as often as needed, and no more."""

import uuid
from types import SimpleNamespace

from panoply import cli
from panoply.sources import files, posefiles


def counted(folder, run):
    """run, leaving a file in the folder each time that it is called."""

    def call(batches):
        (folder / uuid.uuid4().hex).touch()
        yield from run(batches)

    return call


def model(tmp_path):
    (tmp_path / "images.txt").write_text("\n".join(f"{i} 1 0 0 0 {-i * i} 0 0 1 frame_{i:05d}.jpg\n" for i in range(1, 6)) + "\n")
    return str(tmp_path / "images.txt")


def test_a_trajectory_report_parses_its_poses_once(spark, tmp_path, monkeypatch):
    seen, poses = tmp_path / "seen", files.poses
    seen.mkdir()
    schema = "path string, image_id long, image_name string, q array<double>, t array<double>, cx double, cy double, cz double"
    monkeypatch.setattr(files, "poses", lambda *a, **k: poses(*a, **k).mapInArrow(counted(seen, iter), schema))
    report = cli.trajectory_report(spark, SimpleNamespace(images_txt=model(tmp_path), output_dir=f"{tmp_path}/out", expected_images=5))
    assert report["registered_images"] == 5 and len(list(seen.iterdir())) == 1


def test_pose_splits_are_noted_once(spark, tmp_path, monkeypatch):
    seen, note = tmp_path / "seen", posefiles._note
    seen.mkdir()
    monkeypatch.setattr(posefiles, "_note", counted(seen, lambda batches: note(batches)))
    assert sorted(r.image_id for r in posefiles.poses(spark, model(tmp_path)).collect()) == [1, 2, 3, 4, 5] and len(list(seen.iterdir())) == 1
