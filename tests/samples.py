"""Small catalogue rows and the folder of the smallest tables, shared by tests."""

SF = "/root/testdata/sf0.001"


def film(id, title, overview, **more):
    row = {
        "id": id, "title": title, "overview": overview, "release_date": "2001-12-31",
        "vote_average": 5.0, "vote_count": 8, "popularity": 9.0, "genres": ["Drama"],
        "runtime": 90, "budget": 0, "revenue": 0, "poster_path": "", "backdrop_path": "",
        "original_language": "en", "tagline": "", "keywords": [], "cast": [], "director": "",
    }
    row.update(more)
    row["cast"] = [
        {"name": n, "character": "", "order": i, "profile_path": ""} for i, n in enumerate(row["cast"])
    ]
    return row


FILMS = [
    film("1", "The Quiet Harbour", "A lighthouse keeper keeps the light burning.",
         genres=["Drama", "Drama", "Mystery"], cast=["Anna Bell", "Tower Marsh"], director="Ida Quill"),
    film("2", "Harbour of Glass", "Glass blowers fight over a quiet town.", vote_average=7.5,
         keywords=["glass", "rivalry"], cast=["Bell Tower"], director="Ida Quill"),
    film("3", "Night Train", "The night train runs late; the train keeper waits.",
         genres=["Crime"], keywords=["train"], director="Otto Reed", vote_average=None),
    film("4", "A Train of Thought", "A late night talk about a quiet train keeper.",
         genres=["Comedy", "Drama"], release_date="1998", popularity=None),
    film("5", "Rivalry", "Two glass makers.", genres=["Crime", "Drama"], release_date="not-a-date",
         keywords=["glass"], director="Otto Reed", vote_average=8.0),
    film("6", "", "", genres=[], release_date="", director="Nobody"),
]
