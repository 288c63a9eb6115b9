"""Sports-video analytics on Spark: frames, detections, tracks, goals and detector evaluation.

Every operator is a function from DataFrames to a DataFrame. Boxes are four plain
columns ``x, y, w, h`` (pixels, top-left corner), a frame is keyed by
``(video_id, frame_idx)``, and order is always a column, never row order.
"""
