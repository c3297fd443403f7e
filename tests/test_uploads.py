"""Bodies of multipart forms at their edges."""

from sparkfolio.sources.uploads import CUT, NO_BOUNDARY, NO_FILE, uploaded_files

FORM = "multipart/form-data; boundary=b"
PART = b'Content-Disposition: form-data; name="file"; filename="a.txt"\r\n\r\n'


def test_uploads_at_their_edges(spark):
    cases = [
        (FORM, b"--b\r\n" + PART + b"x\r\n--b--\r\n", ("a.txt", b"x", None)),
        (FORM, b"before\r\n--b\r\n" + PART + b"\r\n--b--after", ("a.txt", b"", None)),  # a preamble, an empty file, an epilogue
        (FORM, b"--b\r\n" + PART + b"x\r\n--c\r\n\x00\xfe\r\n\r\n\r\n--b--", ("a.txt", b"x\r\n--c\r\n\x00\xfe\r\n\r\n", None)),
        ("Multipart/Form-Data; Boundary=\"b\"", b"--b\r\ncontent-disposition: form-data; filename=\"n\"; name=\"file\"\r\n\r\ny\r\n--b--", ("n", b"y", None)),
        (FORM, b"--b\r\n" + PART.replace(b'"file"', b'"File"') + b"x\r\n--b--", (None, None, NO_FILE)),
        (FORM, b"--b--\r\n--b\r\n" + PART + b"x\r\n--b--", (None, None, NO_FILE)),  # after the closing boundary
        (FORM, b"--b\r\n" + PART + b"x", (None, None, CUT)),
        (FORM, b"--b\r\nno head", (None, None, NO_FILE)),
        (FORM, b"", (None, None, NO_FILE)),
        (FORM, None, (None, None, NO_FILE)),
        ("text/plain; boundary=b", b"--b\r\n" + PART + b"x\r\n--b--", (None, None, NO_BOUNDARY)),
        (None, b"x", (None, None, NO_BOUNDARY)),
    ]
    rows = [(i, kind, None if body is None else bytearray(body)) for i, (kind, body, _) in enumerate(cases)]
    files = uploaded_files(spark.createDataFrame(rows, "id int, content_type string, body binary"))
    got = {x.id: (x.name, None if x.content is None else bytes(x.content), x.refusal) for x in files.collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}
    assert all(x.length == (None if x.content is None else len(x.content)) for x in files.collect())
    assert files.limit(0).count() == 0
