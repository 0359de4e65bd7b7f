"""Raw-file text derived from the events table, with every kind of mess the cleaning handles.

The expressions are plain SQL that Spark and DuckDB read alike; only the time
formatting differs and is passed in.
"""

MESSY_NUMBER = (
    "CASE event_id % 8 WHEN 0 THEN concat('0', user_id) WHEN 1 THEN concat(user_id, '.0') "
    "WHEN 2 THEN concat(' ', user_id, '.7 ') WHEN 3 THEN 'abc' WHEN 4 THEN '99999999999999999999' "
    "WHEN 5 THEN '  ' WHEN 6 THEN concat('-', user_id, '.5') ELSE concat(user_id, 'e1') END"
)
MESSY_FLAG = (
    "CASE event_id % 6 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'false' WHEN 2 THEN 'yes' WHEN 3 THEN '' "
    "WHEN 4 THEN NULL ELSE 'False' END"
)


def messy_time(padded: str, bare: str, iso: str) -> str:
    return (
        f"CASE event_id % 9 WHEN 0 THEN {bare} WHEN 1 THEN concat('  ', {padded}, ' ') WHEN 2 THEN lower({padded}) "
        f"WHEN 3 THEN concat('13/', substr({padded}, 4)) WHEN 4 THEN {iso} WHEN 5 THEN '' ELSE {padded} END"
    )


def raw_columns(padded: str, bare: str, iso: str) -> dict[str, str]:
    """Raw column name to SQL expression."""
    time = messy_time(padded, bare, iso)
    return {
        "ID": f"CASE WHEN event_id % 11 = 0 THEN {MESSY_NUMBER} ELSE concat(event_id, '') END",
        "Case Number": "concat('C', event_id)",
        "Date": time,
        "Block": "event_type",
        "IUCR": "props",
        "Primary Type": "CASE WHEN event_id % 17 <> 0 THEN upper(event_type) END",
        "Description": "concat(event_type, ', \"quoted\"')",
        "Location Description": "''",
        "Arrest": MESSY_FLAG,
        "Domestic": "CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'FALSE' END",
        "Beat": "concat(user_id, '')",
        "District": f"CASE WHEN event_id % 7 = 0 THEN {MESSY_NUMBER} ELSE concat('0', user_id % 25 + 1) END",
        "Ward": MESSY_NUMBER,
        "Community Area": "concat(user_id % 77, '.0')",
        "FBI Code": "concat('F', user_id % 20)",
        "X Coordinate": "concat(user_id, '.25')",
        "Y Coordinate": MESSY_NUMBER,
        "Latitude": "concat('41.', 5000 + event_id % 5000)",
        "Longitude": "concat('-87.', 4000 + event_id % 5000)",
        "Location": "concat('(', user_id, ', ', event_id, ')')",
        "Updated On": time,
    }


def raw_lines(order: int) -> str:
    """Array of the raw lines of one event: ID, date and note, in two orders."""
    good = "date_format(ts, 'MM/dd/yyyy hh:mm:ss a')"

    def row(date: str, note: str) -> str:
        second, third = (date, note) if order == 0 else (note, date)
        return f"concat(event_id, ',', {second}, ',', {third})"

    long = """concat('"', repeat('ab, ', 2500), '"')"""
    short = good if order == 0 else "event_type"
    return (
        f"CASE event_id % 7 WHEN 0 THEN array(concat({row(good, 'event_type')}, ',extra')) "
        f"WHEN 1 THEN array(concat(event_id, ',', {short})) "
        f"""WHEN 2 THEN array(concat(event_id, ',"', event_type), concat('more",', {good})) """
        f"WHEN 3 THEN array({row(good, long)}) WHEN 4 THEN array({row("'no date'", 'event_type')}) "
        f"ELSE array({row(good, 'event_type')}) END"
    )


#: The note of an event: one line, or several with blanks, separators, quotes and empty lines among them.
NOTE = (
    "CASE event_id % 5 WHEN 0 THEN concat(event_type, chr(10), 'more, of ', user_id) "
    "WHEN 1 THEN concat('\"', event_type, '\"', chr(10), chr(10), 'a \"word\"', chr(10), ',end') "
    "WHEN 2 THEN concat('x', repeat(concat(chr(10), event_type, ','), cast(event_id % 97 AS int)), 'y') "
    "WHEN 3 THEN concat('5\" ', event_type) ELSE event_type END"
)
RECORD = f"""concat(event_id, ',"', replace({NOTE}, '"', '""'), '",', user_id)"""
