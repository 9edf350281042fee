"""Labels the data and the results carry."""

WON = "vundet"
LOST = "tabt"
DRAWN = "uafgjort"
POINTS = {LOST: 0, DRAWN: 1, WON: 3}

NOT_PLAYED = "Optakt"
NO_HOLIDAY = "ingen"
FIRST_MEETING = "første møde"
RARE_OPPONENTS = "andre_hold"

# first hour, last hour, label
DAY_PARTS = ((10, 14, "middag"), (15, 17, "eftermiddag"), (18, 23, "aften"))

ZONE = "Europe/Copenhagen"
