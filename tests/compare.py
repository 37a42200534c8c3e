from __future__ import annotations


def rows_of(frame, columns):
    f = frame[columns].astype(object)
    return sorted(map(str, f.where(f.notna(), None).itertuples(index=False, name=None)))
