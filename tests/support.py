"""Helpers of the tests.  Not in a conftest: a second one further down would hide it from imports."""

import os

SF001 = "/root/testdata/sf0.001"


def write_files(folder, files):
    """Write {relative name: text} below folder; return folder."""
    for name, text in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as fh:
            fh.write(text)
    return folder
