"""Tables that audits keep: facts replaced by device, ledgers that grow by one segment at a time."""
