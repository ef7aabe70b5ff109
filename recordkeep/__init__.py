"""recordkeep: keeps a catalogue of records correct while imperfect sources feed it, on Spark."""
