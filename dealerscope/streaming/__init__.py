"""Empty on purpose: the workload is batch only (full reload, dated reports).

No stream, watermark or stateful step belongs to it, so none is offered here.
"""
