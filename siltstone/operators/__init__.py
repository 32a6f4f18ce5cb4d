"""Pure DataFrame-to-DataFrame operators over versioned rows.

A row is (key, seq, op, value): ``op`` 1 is a put, 2 a delete (a tombstone
row with a null value); the row of a key with the largest ``seq`` is current.
"""

PUT, DELETE = 1, 2
